"""Structure-aware scores, two sites, mean field, footprints, free protein, descents, codebooks, curves and densities against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from utrflow.operators import density, descent, discretise, fitting, footprints, meanfield, nonlinear, protein, structure
from utrflow.plans.storage import new_path

BASES = "ACGT"


def random_reads(n, length, seed=0, letters="ACGT"):
    r = np.random.default_rng(seed)
    return ["".join(r.choice(list(letters), int(r.integers(length[0], length[1] + 1)))) for _ in range(n)]


def random_weights(k, seed):
    w = np.random.default_rng(seed).uniform(0.05, 1, (k, 4))
    return w / w.max(axis=1, keepdims=True)


def sites(seq, w, nonspecific=0.0):
    out = []
    for i in range(len(seq) - len(w) + 1):
        z = 1.0
        for d, row in enumerate(w):
            b = "ACGT".find(seq[i + d].upper().replace("U", "T"))
            z *= row[b] if b >= 0 else 0.0
        out.append(float(z + nonspecific))
    return out


def motif(w, **more):
    return structure.Motif(tuple(map(tuple, w.tolist())), **more)


# --- structure


@pytest.mark.parametrize("shift,scale,nonspecific", [(0, 1.0, 0.0), (-2, 0.5, 0.01), (4, 2.0, 0.0)])
def test_sites_ask_of_the_structure(spark, shift, scale, nonspecific):
    left, right, w = "GATTACA", "CCGGTTA", random_weights(4, 1)
    r = np.random.default_rng(2)
    reads = [(i, s, r.uniform(0.01, 1, len(left + s + right) - 2).tolist()) for i, s in enumerate(random_reads(20, (0, 40), letters="ACGTN"))] + [(98, None, [0.5]), (99, "ACGT", None)]
    df = spark.createDataFrame(reads, "read_id long, seq string, acc array<double>")
    got = {x["read_id"]: x for x in structure.with_totals(structure.with_sites(df, [motif(w, acc="acc", shift=shift, scale=scale)], nonspecific, left, right)).collect()}
    for i, s, acc in reads[:-2]:
        whole = left[-3:] + s + right[:3]
        want = []
        for at, z in enumerate(sites(whole, w, nonspecific)):
            place = at + len(left) - 3 + shift
            want.append(z * acc[place] ** scale if 0 <= place < len(acc) else 0.0)
        assert np.allclose(got[i]["z_sites"], want) and np.isclose(got[i]["z"], sum(want))
        if want:
            assert np.isclose(got[i]["best"], max(want)) and got[i]["z_sites"][got[i]["place"]] == got[i]["best"]
    assert got[98]["z_sites"] == [] and not any(got[99]["z_sites"])


def test_motifs_are_relative_to_the_strongest(spark):
    one, two = random_weights(4, 3), random_weights(3, 4)
    df = spark.createDataFrame([(0, "ACGTTGCAAC"), (1, "AC")], "read_id long, seq string")
    motifs = [motif(one, a0=2.0), motif(two, a0=8.0)]
    together, apart = (structure.with_sites(df, motifs, split=s).orderBy("read_id").collect() for s in (False, True))
    a, b = np.array(sites("ACGTTGCAAC", one)) / 4, np.array(sites("ACGTTGCAAC", two))
    assert np.allclose(apart[0]["z_sites_0"], a) and np.allclose(apart[0]["z_sites_1"], b)
    assert np.allclose(together[0]["z_sites"], b + np.append(a, 0)) and together[1]["z_sites"] == []


def test_two_sites_equal_the_double_loop(spark):
    r, costs = np.random.default_rng(5), [0.5, 0.0, 0.3, 0.2]
    rows = [(i, r.uniform(0, 1, n).tolist(), r.uniform(0, 1, n).tolist()) for i, n in enumerate((0, 1, 2, 5, 30, 300))] + [(6, None, [1.0])]
    df = spark.createDataFrame(rows, "read_id long, a array<double>, b array<double>").repartition(2)
    got = {x["read_id"]: x["z"] for x in structure.two_site_totals(df, "a", "b", costs, ["read_id"]).collect()}
    assert got[6] is None and len(got) == 7
    for i, a, b in rows[:-1]:
        want = sum(a) + sum(b) + sum(b[j] * a[m] * costs[j - m - 1] for j in range(len(b)) for m in range(j) if j - m <= len(costs))
        assert np.isclose(got[i], want)
    spacing = {x["d"]: (x["z"], x["n"]) for x in structure.spacing_profile(df.filter("read_id < 6"), "a", "b", 5, 3, 6).collect()}
    for d in range(-6, 7):
        pairs = [(a[i], b[j]) for _, a, b in rows[:-1] for i in range(len(a)) for j in range(len(b)) if j - i + 2 == d]
        assert spacing[d][1] == len(pairs) and np.isclose(spacing[d][0], sum(x * y for x, y in pairs))


def test_openness_round_kmers(spark):
    r = np.random.default_rng(6)
    reads = [(i, s, r.integers(0, 8, len(s) + 3).tolist(), int(r.integers(0, len(s) + 1))) for i, s in enumerate(random_reads(30, (1, 30), 7, "ACGTN"))]
    df = spark.createDataFrame([*reads, (99, "ACGT", None, None), (100, None, [1], 0)], "read_id long, seq string, levels array<int>, at int")
    k, reach, shift = 2, 3, 2
    want, round_want = {}, {}
    for _, s, levels, at in reads:
        for i in range(len(s) - k + 1):
            if "N" not in s[i : i + k]:
                for d in range(-reach, k + reach):
                    if 0 <= i + d + shift < len(levels):
                        key = (s[i : i + k], d, levels[i + d + shift])
                        want[key] = want.get(key, 0) + 1
        if at >= 1 and at + 2 < len(levels):
            for d in range(-1, 3):
                round_want[d, levels[at + d]] = round_want.get((d, levels[at + d]), 0) + 1
    counted = structure.kmer_openness(df, k, "levels", reach, shift, bins=8)
    assert {(x["kmer"], x["d"], x["level"]): x["n"] for x in counted.collect()} == want
    means = {(x["kmer"], x["d"]): x["mean"] for x in structure.mean_openness(counted).collect()}
    for kmer, d in means:
        own = {level: n for (a, b, level), n in want.items() if (a, b) == (kmer, d)}
        assert np.isclose(means[kmer, d], sum(a * n for a, n in own.items()) / sum(own.values()))
    assert {(x["d"], x["level"]): x["n"] for x in structure.openness_round(df, "at", "levels", 1, 2).collect()} == round_want
    hits = {(x["read_id"], x["pos"]): x["acc"] for x in structure.kmer_accessibilities(df, "AC", "levels", shift).collect()}
    assert hits == {(i, p): levels[p + shift] for i, s, levels, _ in reads for p in range(len(s) - 1) if s[p : p + 2] == "AC"} | {(99, 0): None}
    with pytest.raises(ValueError):
        structure.kmer_openness(df, 9, "levels", 5)


# --- free protein


def test_exact_free_protein(spark):
    z = np.random.default_rng(8).lognormal(0, 3, 3000)
    df = spark.createDataFrame([(float(x),) for x in [*z, 0.0]] + [(None,)], "z double").repartition(5)
    for f, total in zip(protein.exact_free(df, [0.5, 5.0, 500.0], 100.0, scale=0.1), (0.5, 5.0, 500.0), strict=True):
        x = f.value * z * 0.1
        assert abs(f.value + 100 * (x / (x + 1)).mean() - total) < 1e-9 * total and f.error <= 1e-12 * total and f.passes <= 8
    nothing = protein.exact_free(df.filter("z is null"), [2.0], 1.0)[0]
    assert nothing.value == 2.0 and nothing.error == 0


# --- mean field


@pytest.fixture(scope="module")
def field(spark):
    df = spark.createDataFrame(list(enumerate(random_reads(300, (15, 25), 9))), "read_id long, seq string")
    near = meanfield.neighbours(df, 3)
    model = fitting.Model([random_weights(3, 10)], np.array([0.7]), np.array([0.05, 0.2]))
    return df, near, model


def test_mean_field_equals_numpy(field):
    df, near, model = field
    m, n = np.zeros((64, 64)), np.zeros(64)
    for r in df.collect():
        index = [int("".join(str(BASES.index(b)) for b in r["seq"][i : i + 3]), 4) for i in range(len(r["seq"]) - 2)]
        for i, a in enumerate(index):
            n[a] += 1
            for b in index[max(0, i - 3) : i + 4]:
                m[a, b] += 1
    m, f0 = m / n[:, None], n / n.sum()
    assert np.allclose(near.shares, f0)
    state = meanfield.states(near, [model], [0.5, 4.0], np.ones((2, 64)))[0]
    a = np.array([0.7 * model.weights[0][0, i // 16] * model.weights[0][1, i // 4 % 4] * model.weights[0][2, i % 4] for i in range(64)])
    assert np.allclose(state.affinity, a)
    for s, p in enumerate((0.5, 4.0)):
        w = f0 * (m @ (p * a / (p * a + 1)) + model.betas[s])
        assert np.allclose(state.enriched[s], w / w.sum() / f0)


def test_mean_field_gradient_against_differences(field):
    _, near, model = field
    observed = np.random.default_rng(11).uniform(0.5, 2, (2, 64))
    v = model.vector()
    g = meanfield.gradient(near, meanfield.states(near, [model], [0.5, 4.0], observed)[0], observed)
    raw = lambda x: fitting.Model([x[:12].reshape(3, 4)], x[12:13], x[13:])
    trials = [raw(v + s * h) for i in range(len(v)) for h in [np.eye(len(v))[i] * 1e-6 * v[i]] for s in (1, -1)]
    errors = np.array([s.error for s in meanfield.states(near, trials, [0.5, 4.0], observed)]).reshape(-1, 2)
    assert np.allclose(g, (errors[:, 0] - errors[:, 1]) / (2e-6 * v), rtol=1e-4, atol=1e-9)


def test_mean_field_fit_finds_the_motif(field):
    """The enrichments of a known model; from a flat start the descent halves the error many times."""
    _, near, model = field
    observed = meanfield.states(near, [model], [0.5, 4.0], np.ones((2, 64)))[0].enriched
    start = fitting.Model([np.full((3, 4), 0.5)], np.array([0.3]), np.array([0.1, 0.1]))
    evaluate, errors_of = meanfield.evaluator(near, [0.5, 4.0], observed)
    found = descent.descend(start, evaluate, errors_of, steps=25)
    assert found.errors[-1] < found.errors[0] / 30 and all(b < a for a, b in zip(found.errors, found.errors[1:], strict=False))


def test_kmer_gradient_against_differences(spark):
    df = spark.createDataFrame(list(enumerate(random_reads(40, (2, 15), 12, "ACGTN"))), "read_id long, seq string").repartition(3)
    model = fitting.Model([random_weights(3, 13)], np.array([0.8]), np.zeros(0))
    pi, slopes = meanfield.kmer_gradient(df, model, 1.5, 2)
    v = model.vector()
    for i in (0, 5, 11, 12):
        h = np.eye(len(v))[i] * 1e-6
        ends = [meanfield.kmer_gradient(df, fitting.Model([x[:12].reshape(3, 4)], x[12:], np.zeros(0)), 1.5, 2)[0] for x in (v + h, v - h)]
        assert np.allclose(slopes[:, i], (ends[0] - ends[1]) / 2e-6, rtol=1e-4, atol=1e-6)
    assert pi.sum() > 0


# --- descent and its history


class Bowl:
    """A sum of squares of log distances from (1, 2, 3)."""

    def __init__(self, v):
        self.v = np.array(v, float)

    def vector(self):
        return self.v

    def like(self, v):
        return Bowl(v)

    def error(self):
        return float((np.log(self.v / [1, 2, 3]) ** 2).sum() + 1)

    def gradient(self):
        return 2 * np.log(self.v / [1, 2, 3]) / self.v


def bowl(steps, **more):
    return descent.descend(Bowl([5, 5, 5]), lambda m: (m.error(), m.gradient()), lambda ms: [m.error() for m in ms], steps=steps, **more)


def test_descent_finds_the_least(spark):
    found = bowl(200)
    assert np.allclose(found.model.v, [1, 2, 3], atol=1e-2) and found.errors[-1] < 1 + 1e-4 and found.status != "steps"


def test_descent_goes_on_from_its_history(spark):
    path, other = (new_path(spark, "history") for _ in range(2))
    whole = bowl(8, spark=spark, path=path)
    bowl(3, spark=spark, path=other)
    rest = bowl(8, spark=spark, path=other)
    assert np.allclose(whole.errors, rest.errors) and np.allclose(whole.model.v, rest.model.v) and len(rest.errors) == 9
    table = descent.history(spark, other)
    assert table.groupBy("step").count().filter("count = 3").count() == 9
    last = resumed = descent.resumed(spark, other, Bowl([5, 5, 5]))
    descent.append_step(spark, other, 8, resumed.errors[-1], resumed, 0.0)  # a step written again replaces itself
    assert descent.history(spark, other).count() == 27 and descent.resumed(spark, other, Bowl([5, 5, 5])).errors == last.errors
    spark.createDataFrame([(1.0, 0, 1.0, 1.0, 1.0, 0.0)], "error double, parameter int, value double, way double, spread double, moved double").write.parquet(f"{other}/step=9")
    assert len(descent.resumed(spark, other, Bowl([5, 5, 5])).errors) == 9  # a step of which a part is missing doesn't count
    quartiles = {r["parameter"]: r["mid"] for r in fitting.parameter_errors(descent.history(spark, path), tolerance=0.05, least=3).collect()}
    assert set(quartiles) == {0, 1, 2}
    assert bowl(8, spark=spark, path=path).errors == whole.errors
    descent.forget(spark, path)
    assert descent.resumed(spark, path, Bowl([5, 5, 5])).errors == []


def test_residuals(spark):
    got = {(r["kmer"], r["sample"]): r["residual"] for r in descent.residuals(spark, np.array([[2.0] * 16, [1.0] * 16]), np.ones((2, 16)), 2).collect()}
    assert len(got) == 32 and got["AU", 0] == 1 and got["UU", 1] == 0


# --- footprints


@pytest.fixture(scope="module")
def folded(spark):
    """Reads whose windows of three bases are as open as their bases together; bound ones drawn by a known footprint."""
    r = np.random.default_rng(14)
    w, rows = random_weights(4, 15), []
    for i, s in enumerate(random_reads(1500, (24, 24), 16)):
        one = r.uniform(0.05, 1, 24)
        rows.append((i, sites(s, w), one.tolist(), [float(np.prod(one[j : j + 3])) for j in range(22)]))
    return rows, spark.createDataFrame(rows, "read_id long, z array<double>, one array<double>, three array<double>").repartition(4)


def plain_prediction(rows, k, shift, scale, a0, totals, rna, width, pad):
    z_reads = []
    for _, z, _, three in rows:
        z_reads.append(sum(x * (three[i + shift] ** scale if 0 <= i + shift < len(three) else 0.0) if k and scale else x for i, x in enumerate(z)))
    z_reads, out = np.array(z_reads), []
    for total in totals:
        low, high = 0.0, total
        for _ in range(100):
            p = (low + high) / 2
            y = p * a0 * z_reads[z_reads > 0]
            low, high = (low, p) if p + rna * (y / (y + 1)).mean() > total else (p, high)
        psi = low * a0 * z_reads / (low * a0 * z_reads + 1)
        number, norm = np.zeros(width + 2 * pad), 0.0
        for own, (_, z, one, _) in zip(psi, rows, strict=True):
            for i in range(pad, len(z) - pad):
                norm += own * z[i]
                for d in range(-pad, width + pad):
                    number[d + pad] += own * z[i] * (one[i + d] if 0 <= i + d < len(one) else 0.0)
        out.append(number / norm)
    return np.array(out)


def test_predicted_profiles_equal_the_loops(folded):
    rows, df = folded
    rows = rows[:150]
    reads = footprints.Reads(df.filter("read_id < 150"), "z", "one", {3: "three"})
    points = [footprints.Footprint(3, 1, 0.7, 2.0), footprints.Footprint(3, -2, 1.0, 0.5), footprints.Footprint(0, 0, 0.0, 1.0)]
    free = footprints.free_by_footprint(reads, points, [1.0, 20.0], 10.0)
    got = footprints.predicted_profiles(reads, points, free, 4, 2)
    for own, p in zip(got, points, strict=True):
        assert np.allclose(own, plain_prediction(rows, p.k, p.shift, p.scale, p.a0, [1.0, 20.0], 10.0, 4, 2), rtol=2e-4)
    naive = footprints.observed_profile(reads, 4, 2)
    number = np.array([sum(z[i] * one[i + d] for _, z, one, _ in rows for i in range(2, len(z) - 2)) for d in range(-2, 6)])
    assert np.allclose(naive, number / sum(sum(z[2 : len(z) - 2]) for _, z, _, _ in rows))


def test_calibration_finds_the_footprint(folded):
    _, df = folded
    reads = footprints.Reads(df, "z", "one", {3: "three"})
    truth = footprints.Footprint(3, 1, 0.6, 3.0)
    observed = footprints.predicted_profiles(reads, [truth], footprints.free_by_footprint(reads, [truth], [1.0, 20.0], 10.0), 4, 2)[0]
    fits = footprints.calibrated(reads, observed, [1.0, 20.0], 10.0, 4, 2, a0=1.0, shifts={3: [0, 1, 2]}, rounds=5)
    best = fits[0]
    assert (best.footprint.k, best.footprint.shift) == (3, 1) and abs(best.footprint.scale - 0.6) < 0.1
    assert best.error < fits[1].error / 5 and best.error < best.plain / 50 and fits[-1].footprint.k == 0 and len(fits) == 4


def test_threshold(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 101)], "z double")
    assert footprints.threshold(df, share=0.9) == 90.0 and footprints.threshold(df) == 50.0


# --- codebooks


def test_gamma_fit_and_quantiles(spark):
    x = np.random.default_rng(17).gamma(2.5, 1.7, 4000)
    df = spark.createDataFrame([(float(v) + 1,) for v in x] + [(None,), (0.5,)], "e double").repartition(3)
    got = discretise.fit_gamma(df, "e", start=1.0)
    first, _ = discretise._digamma(np.array([got.shape]))
    assert abs(np.log(got.shape) - first[0] - (np.log(x.mean()) - np.log(x).mean())) < 1e-12 and abs(got.shape * got.scale - x.mean()) < 1e-9
    assert abs(got.shape - 2.5) < 0.2
    for shape in (0.3, 1.0, 2.5, 60.0):
        q = np.linspace(0.001, 0.999, 50)
        x = discretise.gamma_quantiles(shape, q)
        assert np.allclose(discretise.gamma_cdf(shape, x), q, atol=1e-12)
        grid = np.linspace(0, x[-1], 400_001)[1:]
        pdf = np.exp((shape - 1) * np.log(grid) - grid - discretise._log_gamma(shape))
        if shape >= 1:  # the integral of the density, by trapezoids
            area = np.concatenate([[0], np.cumsum((pdf[1:] + pdf[:-1]) / 2 * np.diff(grid))]) + discretise.gamma_cdf(shape, grid[:1])
            assert np.allclose(area, discretise.gamma_cdf(shape, grid), atol=1e-6)
    assert np.allclose(discretise.gamma_quantiles(1.0, np.array([0.5])), np.log(2))
    with pytest.raises(ValueError):
        discretise.fit_gamma(df.filter("e = 0.5"), "e")


def test_codebook_round_trip(spark):
    x = np.random.default_rng(18).gamma(2.0, 3.0, 2000)
    book = discretise.Codebook.of_gamma(discretise.Gamma(2.0, 3.0), 64)
    df = spark.createDataFrame([(float(a), [float(a), float(b)]) for a, b in zip(x, x[::-1], strict=True)] + [(None, None)], "e double, es array<double>")
    got = df.select("e", book.encoded(F.col("e")).alias("level"), book.encoded(F.col("es"), array=True).alias("levels")).withColumn("back", book.decoded(F.col("level"))).collect()
    for r in got[:-1]:
        own = max(i for i in range(64) if book.edges[i] <= r["e"])
        assert r["level"] == own == r["levels"][0] and r["back"] == book.values[own] and book.edges[own] <= r["back"] <= book.edges[own + 1]
    assert got[-1]["level"] is None and got[-1]["levels"] is None and got[-1]["back"] is None
    counts = np.bincount([r["level"] for r in got[:-1]], minlength=64)
    assert counts.min() > 10 and counts.max() < 70  # equal shares
    _, y = book.density(counts, normed=True)
    assert np.isclose(((y[1:] + y[:-1]) / 2 * np.diff(book.values)).sum(), 1)
    line = discretise.Codebook.linear(8.0, 4)
    assert line.edges.tolist() == [-2, 2, 4, 6, 8] and line.values.tolist() == [1, 3, 5, 7]


# --- curve


def test_curve_fit(spark):
    r = np.random.default_rng(19)
    z, f0 = r.lognormal(-1, 2, 800), r.dirichlet(np.ones(800))
    h = 5 * z / (5 * z + 1) + 0.03
    lr = np.log2(h / (f0 * h).sum()) + r.normal(0, 0.05, 800)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(z, f0, lr, strict=True)] + [(None, 0.1, 1.0), (0.0, 0.1, 1.0), (1.0, None, 1.0)], "z double, f0 double, lr double").repartition(3)
    got = nonlinear.fit_curve(df)
    assert abs(got.concentration / 5 - 1) < 0.1 and abs(got.background / 0.03 - 1) < 0.1 and got.error < 0.01

    def error(c, b):
        x = c * z / (c * z + 1) + b
        return ((np.log2(x / (f0 * x).sum()) - lr) ** 2).mean()

    assert np.isclose(got.error, error(got.concentration, got.background))
    assert all(error(got.concentration * a, got.background * b) > got.error - 1e-12 for a in (0.999, 1, 1.001) for b in (0.999, 1, 1.001))
    rows = nonlinear.predicted(df, got).filter("lr is not null and z > 0 and f0 is not null").collect()
    assert np.isclose(np.mean([(x["lr_predicted"] - x["lr"]) ** 2 for x in rows]), got.error)
    assert nonlinear.fit_curve(df.limit(0)).steps == 0


# --- density


def test_density_equals_kernels(spark):
    r = np.random.default_rng(20)
    p = np.concatenate([r.multivariate_normal([0, 0], [[1, 0.7], [0.7, 1]], 900), r.uniform(-6, 6, (20, 2))])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)] + [(-1, None, 1.0), (-2, float("nan"), 1.0)], "id long, x double, y double").repartition(3)
    got = density.density(df, "x", "y")
    assert got.counts.sum() == 920
    cov = np.cov(p.T) * 920 ** (-1 / 3)
    inverse = np.linalg.inv(cov)
    for i, j in ((50, 50), (40, 60), (10, 90)):
        centre = np.array([got.low[0] + (i + 0.5) * got.step[0], got.low[1] + (j + 0.5) * got.step[1]])
        d = p - centre
        want = np.exp(-0.5 * np.einsum("ni,ij,nj->n", d, inverse, d)).mean() / (2 * np.pi * np.sqrt(np.linalg.det(cov)))
        assert abs(got.values[i, j] - want) < 0.03 * got.values.max()
    marked = density.outliers(df, got, "x", "y", 5).toPandas()
    out = marked[marked["outlier"] == True]  # noqa: E712
    assert 10 <= len(out) <= 46 and (out["id"] >= 900).sum() >= 12 and len(marked) == 922
    assert density.density(df.limit(0), "x", "y").values.sum() == 0
    line = density.density(spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)], "x double, y double"), "x", "y")
    assert np.isfinite(line.values).all() and line.counts.sum() == 3


# --- motifs along sequences


def test_placed_equals_the_loops(spark):
    from utrflow.operators import psam

    r = np.random.default_rng(21)
    w = r.uniform(0.05, 1, (5, 4))

    def score(seq, o, product, ends):
        z = 1.0 if product else 0.0
        for i in range(5):
            if 0 <= i - o < len(seq):
                b = "ACGU".find(seq[i - o])
                each = w[i, b] if b >= 0 else None
            else:
                each = {"least": w[i].min(), "mean": w[i].mean(), "none": None}[ends]
            if each is not None:
                z = z * each if product else z + each
        return z

    for seq in ("ACG", "UUGCANN", "A", "GGGUUUAAACCC"):
        for product in (True, False):
            for ends in ("least", "mean", "none"):
                for least in (1, min(2, len(seq))):
                    best = max((score(seq, o, product, ends), -o) for o in range(least - len(seq), 6 - least))
                    got = psam.placed(w, seq, product, ends, least)
                    assert got[0] == -best[1] and np.isclose(got[1], best[0])
    assert psam.placed(w, "ACG", False, contained=True)[0] in range(-2, 3) and np.isclose(psam.placed(w, "ACG", False, relative=True)[1] * w.max(axis=1).sum(), psam.placed(w, "ACG", False)[1])
    top = psam.highest_scoring(spark, w.tolist(), 3, 5).collect()
    every = sorted(((psam.placed(w, a + b + c)[1], a + b + c, psam.placed(w, a + b + c)[0]) for a in "ACGU" for b in "ACGU" for c in "ACGU"), reverse=True)[:5]
    assert [(x["kmer"], x["offset"]) for x in top] == [(k, o) for _, k, o in every] and np.allclose([x["score"] for x in top], [s for s, _, _ in every])


def test_motifs_are_built_from_kmers():
    from utrflow.operators import psam, seeding

    kmers = [("UGCAUG", 10.0), ("GCAUGU", 6.0), ("UGCACG", 4.0), ("UUGCAU", 3.0), ("CCCCCC", 5.0), ("CCCCCA", 2.0)]
    one = seeding.Alignment.of("UGCAUG", 10.0)
    assert one.best("GCAUGU") == pytest.approx((50 / 60, 1)) and one.best("UGCACG") == pytest.approx((50 / 60, 0))
    both = seeding.build(kmers, support=2)
    assert len(both) == 2 and [a0 for a0, _ in both] == pytest.approx([0.01, 0.005]) and "GCAU" in psam.consensus(both[0][1]).upper() and "CCCC" in psam.consensus(both[1][1]).upper()
    assert len(seeding.build(kmers)) == 1 and seeding.build([]) == []
    one.add("GCAUGU", 6.0, 1)
    assert one.weights.shape == (7, 4) and one.heaviest == 10 and one.widest_score(2) == 32
    m = one.motif(keep=1.0, most=0, pseudo=0.0)  # the seventh column holds 6 of 16: 1 - 6 / 16 is added, then rows are scaled
    assert m[6].tolist() == pytest.approx([0.625 / 6.625, 0.625 / 6.625, 0.625 / 6.625, 1.0]) and m[1].tolist() == [0, 0, 1, 0]
    assert len(one.motif(keep=0.9)) == 6


# --- states


def test_state_fit_and_slope(spark):
    from utrflow.operators import states

    r = np.random.default_rng(30)
    seqs = random_reads(400, (12, 18), 31)
    z = r.lognormal(0, 2, 400)
    df = spark.createDataFrame([(s, float(x)) for s, x in zip(seqs, z, strict=True)] + [(None, 1.0), ("ACGT", None)], "seq string, z double").repartition(3)
    counts = states.kmer_counts(df, 2)
    plain = np.zeros(16)
    for s in seqs + ["ACGT"]:
        for i in range(len(s) - 1):
            plain[BASES.index(s[i]) * 4 + BASES.index(s[i + 1])] += 1
    assert np.array_equal(counts, plain)
    samples = states.Samples([2.0, 10.0], 20.0, counts, np.ones((2, 16)), 2)
    truth = states.states(df, [0.7], samples, betas=np.array([0.3, 0.1]))[0]
    x = truth.free[0] * 0.7 * z
    q = np.zeros(16)
    for s, psi in zip(seqs, x / (x + 1), strict=True):
        for i in range(len(s) - 1):
            q[BASES.index(s[i]) * 4 + BASES.index(s[i + 1])] += psi
    assert np.allclose(truth.q[0], q)
    known = states.Samples([2.0, 10.0], 20.0, counts, truth.enriched, 2)
    at = states.states(df, [0.7], known, betas=np.array([0.3, 0.1]))[0]
    assert at.error < 1e-20 and np.allclose(at.beta_estimators(), [[0.3]] * 1 + [[0.1]], rtol=1e-6) and all(c > 0.999 for c, _ in at.correlations())
    best, tried = states.fit_a0(df, known, 1.0)
    assert best.error < 1e-5 and len(tried) >= 30 and best.error <= min(e for _, e in tried)
    off = [states.states(df, [a], known, betas=np.array([0.3, 0.1]), free=np.array([[0.5, 3.0]]))[0] for a in (0.9 - 1e-5, 0.9, 0.9 + 1e-5)]
    assert states.a0_slope(df, off[1]) == pytest.approx((off[2].error - off[0].error) / 2e-5, rel=1e-3)
    specific, rest, complexes = at.concentrations(400, 14)
    assert np.allclose(complexes, [2.0, 10.0] - at.free) and (specific > 0).all() and (rest > 0).all()


def test_correlation_p():
    from utrflow.operators.regression import correlation_p

    assert correlation_p(0.0, 10) == pytest.approx(1.0, abs=1e-6) and correlation_p(1.0, 10) == 0.0 and np.isnan(correlation_p(0.5, 2))
    assert correlation_p(0.632, 10) == pytest.approx(0.05, abs=0.001) and correlation_p(-0.765, 10) == pytest.approx(0.01, abs=0.001)  # tabulated


def test_numbered_by_ranges(spark):
    from utrflow.plans.storage import numbered

    r = np.random.default_rng(40)
    rows = [(int(x), int(y)) for x, y in zip(r.integers(0, 5, 500), r.permutation(500), strict=True)] + [(None, -1)]
    got = numbered(spark.createDataFrame(rows, "a int, b int").repartition(6), ["a", "b"]).orderBy("number").collect()
    assert [x["number"] for x in got] == list(range(501)) and [(x["a"], x["b"]) for x in got] == sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert numbered(spark.createDataFrame([], "a int"), ["a"]).count() == 0
