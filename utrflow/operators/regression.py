"""Logistic and linear models, and rank statistics."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utrflow.functions.measures import logistic


def fit_logistic(df: DataFrame, label: str, features: list[str], rounds: int = 25, tolerance: float = 1e-10) -> dict[str, float]:
    """Coefficients of a binomial model by reweighted least squares; rows with a null are left out.

    A round is one aggregation: the sums of weighted products of features, (p + 1)(p + 2) / 2 + p + 1 numbers.
    """
    names = ["intercept", *features]
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    y = F.col(label).cast("double")
    used = df.select(label, *features).dropna()
    b = np.zeros(len(names))
    for _ in range(rounds):
        mu = logistic(b[0], list(zip(b[1:].tolist(), x[1:], strict=True)))
        frame = used.withColumns({"__mu": mu, "__y": y})
        w = F.col("__mu") * (1 - F.col("__mu"))
        sums = [F.sum(w * x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x))] + [F.sum((F.col("__y") - F.col("__mu")) * v) for v in x]
        got = list(frame.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first())
        if got[0] is None:
            raise ValueError("no complete rows to fit")
        h, n = np.zeros((len(x), len(x))), 0
        for i in range(len(x)):
            for j in range(i, len(x)):
                h[i, j] = h[j, i] = got[n]
                n += 1
        step = np.linalg.lstsq(h, np.array(got[n:]), rcond=None)[0]
        b = b + step
        if np.abs(step).max() < tolerance:
            break
    return dict(zip(names, b.tolist(), strict=True))


def predicted(coefficients: dict[str, float]) -> Column:
    """The response for a row's features: null where a feature is."""
    return logistic(coefficients["intercept"], [(b, F.col(f)) for f, b in coefficients.items() if f != "intercept"])


def flagged(p: Column, cut: float) -> Column:
    return F.when(p.isNotNull(), F.when(p > cut, 1).otherwise(0))


def hash_split(df: DataFrame, id_cols: list[str], n: int, seed: int = 1) -> DataFrame:
    """``n`` rows drawn without replacement by a seeded hash of their ids: the same rows every time."""
    return df.orderBy(F.xxhash64(*id_cols, F.lit(seed)), *id_cols).limit(n)


def linear(df: DataFrame, y: str, x: str, by: list[str] = ()) -> DataFrame:
    """(by, slope, intercept, r, n)."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("r"), F.regr_count(y, x).alias("n"))


def ridge(df: DataFrame, y: str, features: list[str], alpha: float = 0.5) -> dict[str, float]:
    """Coefficients of least squares with alpha * sum b^2 (not of the intercept): one aggregation."""
    cols = [*features, y]
    used = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    sums = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(cols) for b in cols[i:]] + [F.avg(c) for c in cols] + [F.count(F.lit(1))]
    got = list(used.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first())
    k, m, n = len(cols), np.zeros((len(cols), len(cols))), 0
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = got[n]
            n += 1
    mean, rows = np.array(got[n : n + k]), got[-1]
    centred = m - rows * np.outer(mean, mean)
    b = np.linalg.solve(centred[:-1, :-1] + alpha * np.eye(k - 1), centred[:-1, -1])
    return {"intercept": float(mean[-1] - mean[:-1] @ b)} | dict(zip(features, b.tolist(), strict=True))


def average_ranks(value: str, by: list[str] = ()) -> Column:
    """Ranks from 1, equals sharing their mean rank."""
    order = Window.partitionBy(*by).orderBy(value)
    same = Window.partitionBy(*by, value)
    return F.rank().over(order) + (F.count(F.lit(1)).over(same) - 1) / 2


def spearman(df: DataFrame, a: str, b: str, by: list[str] = ()) -> DataFrame:
    """(by, rho)."""
    used = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    return used.withColumns({"__a": average_ranks(a, by), "__b": average_ranks(b, by)}).groupBy(*by).agg(F.corr("__a", "__b").alias("rho"))


def mann_whitney(df: DataFrame, value: str, group: str, one: str, other: str) -> tuple[float, float]:
    """(U of ``one``, two-sided p by the normal approximation with tie correction)."""
    used = df.filter(F.col(group).isin(one, other) & F.col(value).isNotNull())
    ranks = used.withColumn("__r", average_ranks(value))
    r, n1 = ranks.filter(F.col(group) == one).agg(F.sum("__r"), F.count(F.lit(1))).first()
    n, ties = used.groupBy(value).count().agg(F.sum("count"), F.sum(F.pow("count", F.lit(3)) - F.col("count"))).first()
    n2 = (n or 0) - n1
    if not n1 or not n2:
        return float("nan"), float("nan")
    u = r - n1 * (n1 + 1) / 2
    spread = math.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))) if n > 1 else 0.0
    return u, math.erfc(abs(u - n1 * n2 / 2) / spread / math.sqrt(2)) if spread else 1.0


def student_tail(t: float, f: int) -> float:
    """The two-sided tail of Student's distribution, by Simpson's rule on its density from |t| to where it is negligible."""
    upper = abs(t) + 200 * max(1.0, math.sqrt((f + 1) / max(1, f - 2)))
    x = np.linspace(abs(t), upper, 200_001)
    log_c = math.lgamma((f + 1) / 2) - math.lgamma(f / 2) - 0.5 * math.log(f * math.pi)
    y = np.exp(log_c - (f + 1) / 2 * np.log1p(x * x / f))
    return float(min(1.0, 2 * (x[1] - x[0]) / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())))


def correlation_p(r: float, n: int) -> float:
    """The two-sided p of a correlation of n pairs; 0 for a perfect one, nan for fewer than three pairs."""
    if n < 3 or math.isnan(r):
        return float("nan")
    return 0.0 if abs(r) >= 1 else student_tail(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def t_test(df: DataFrame, value: str, against: float = 0.0) -> tuple[float, float]:
    """(t, two-sided p) of the mean against a number."""
    mean, sd, n = df.agg(F.avg(value), F.stddev_samp(value), F.count(value)).first()
    if not n or n < 2 or not sd:
        return float("nan"), float("nan")
    t = (mean - against) / sd * math.sqrt(n)
    return t, student_tail(t, n - 1)
