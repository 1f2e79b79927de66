"""Descent on the error of a model whose parameters are on the driver, and its history as a table.

Each step asks Spark for the error and its gradient, then for the errors of all trial steps at once. With a history every
step is a partition of an append-only table, written whole or not at all: a descent that ended early goes on from the last.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utrflow.functions.sequence import index_kmer
from utrflow.plans.storage import dropped


class Parameters(Protocol):
    """A model: its parameters as a vector of positive numbers, and a model of another such vector."""

    def vector(self) -> np.ndarray: ...

    def like(self, v: np.ndarray) -> Parameters: ...


#: Trial steps in log parameters: the greatest, and how many of them, each a third of the one before.
GREATEST, TRIALS = 1.0, 10


@dataclass
class Descent:
    """Where a descent stands: its model, the averages that give its direction, and the error of each step so far."""

    model: Parameters
    way: np.ndarray | None = None
    spread: np.ndarray | None = None
    errors: list[float] = field(default_factory=list)
    status: str = "running"


_STEP = "step long, error double, parameter int, value double, way double, spread double, moved double"


def append_step(spark: SparkSession, path: str, step: int, error: float, descent: Descent, moved: float) -> None:
    """Writes a step's partition anew: what an earlier attempt left of it goes."""
    v = descent.model.vector()
    way = descent.way if descent.way is not None else [None] * len(v)
    spread = descent.spread if descent.spread is not None else [None] * len(v)
    rows = [(step, error, i, float(x), None if w is None else float(w), None if s is None else float(s), moved) for i, (x, w, s) in enumerate(zip(v, way, spread, strict=True))]
    spark.createDataFrame(rows, _STEP).drop("step").coalesce(1).write.mode("overwrite").parquet(f"{path}/step={step}")


def history(spark: SparkSession, path: str) -> DataFrame:
    """(step, error, parameter, value, way, spread, moved) of all steps that were written whole."""
    return spark.read.schema(_STEP).parquet(path)


def resumed(spark: SparkSession, path: str, start: Parameters) -> Descent:
    """The descent as its last whole step left it; at ``start`` where there is none."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return Descent(start)
    steps = history(spark, path)
    whole = steps.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.first("error").alias("error")).filter(F.col("n") == len(start.vector())).orderBy("step").collect()  # a row a step
    errors = []
    for r in whole:
        if r["step"] != len(errors):
            break
        errors.append(r["error"])
    if not errors:
        return Descent(start)
    rows = steps.filter(F.col("step") == len(errors) - 1).orderBy("parameter").collect()  # as many as parameters
    column = lambda c: None if rows[0][c] is None else np.array([r[c] for r in rows])
    return Descent(start.like(column("value")), column("way"), column("spread"), errors)


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a history."""
    dropped(path, spark)


def converged(errors: Sequence[float], way: np.ndarray | None, slope: float, trend: int, least: float = 1e-7) -> str | None:
    """Why to stop: the error or the averaged gradient is next to nothing, or the error's linear decrease over the last
    ``trend`` steps is below ``slope`` of the first error; None while it goes on."""
    if errors and errors[-1] < least:
        return "least error"
    if way is not None and np.sqrt((way**2).sum()) < least:
        return "no gradient"
    if len(errors) >= trend and -np.polyfit(np.arange(trend), errors[-trend:], 1)[0] / errors[0] < slope:
        return "no more decrease"
    return None


def descend(
    start: Parameters, evaluate: Callable[[Parameters], tuple[float, np.ndarray]], errors_of: Callable[[list[Parameters]], list[float]], steps: int = 500, keep: float = 0.5, slope: float = 1e-6, trend: int = 13, spark: SparkSession | None = None, path: str | None = None
) -> Descent:
    """Down the error from ``start``: directions are averaged gradients by the logarithms of the parameters, over the root of
    averaged squares; of the trial steps along one, all evaluated by one call, the best is taken.

    Where none helps, the plain gradient is tried and the averages start anew; where that doesn't help either, the descent is
    stuck. ``evaluate`` gives the error and its gradient by the parameter vector. With ``path`` the history is kept there, and
    a descent that finds one goes on from it; a history that has ended is left as it is.
    """
    now = resumed(spark, path, start) if path else Descent(start)

    def kept(error: float, moved: float) -> None:
        now.errors.append(error)
        if path:
            append_step(spark, path, len(now.errors) - 1, error, now, moved)

    error, slopes = evaluate(now.model)
    if not now.errors:
        kept(error, 0.0)
    while (why := converged(now.errors, now.way, slope, trend)) is None and len(now.errors) <= steps:
        x = now.model.vector()
        g = slopes * x  # by the logarithms
        way = g if now.way is None else keep * now.way + (1 - keep) * g
        spread = (np.ones(len(g)) if now.spread is None else now.spread) * keep + (1 - keep) * g**2
        for direction, fresh in ((way / (np.sqrt(spread) + 1e-5), False), (g / max(np.sqrt((g**2).sum()), 1e-300), True)):
            scales = GREATEST / 3.0 ** np.arange(TRIALS)
            trials = [now.model.like(x * np.exp(-s * direction)) for s in scales]
            found = errors_of(trials)
            best = int(np.argmin(found))
            if found[best] < error:
                break
        else:
            why = "stuck"
            break
        now.model, now.way, now.spread = trials[best], None if fresh else way, None if fresh else spread
        error, slopes = evaluate(now.model)
        kept(error, float(scales[best]))
    now.status = why or "steps"
    return now


def residuals(spark: SparkSession, predicted: np.ndarray, observed: np.ndarray, k: int, letters: str = "ACGU") -> DataFrame:
    """(kmer, sample, residual): log2 of predicted over observed enrichment, of arrays by sample and k-mer number."""
    r = np.log2(predicted / observed)
    rows = [(int(i), s, float(r[s, i])) for s in range(r.shape[0]) for i in range(r.shape[1])]
    return spark.createDataFrame(rows, "at long, sample int, residual double").select(index_kmer(F.col("at"), k, letters).alias("kmer"), "sample", "residual")
