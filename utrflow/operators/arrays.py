"""Arrays of a fixed size that tasks fill and Spark adds up, array columns laid one after another, and batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch, and letters or array values that are worked on at once: what a task holds doesn't grow with its rows.
BATCH, PORTION = 4 << 20, 1 << 18


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches hold at most 4 MB (or a row), however long reads and their arrays are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def portions(parts: Iterator[pd.DataFrame], size: int = PORTION) -> Iterator[pd.DataFrame]:
    """The rows of the batches in order, in frames whose texts and arrays have about ``size`` letters or values (a row at least).

    Each row counts by the longest of its texts and arrays, and as one.
    """
    for part in parts:
        weight = np.ones(len(part), np.int64)
        for c in part.columns:
            if part[c].dtype == object:
                weight = np.maximum(weight, [len(v) if hasattr(v, "__len__") else 1 for v in part[c]])
        upto = np.cumsum(weight)
        a = 0
        while a < len(part) or not len(part):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + size, "right")))
            yield part.iloc[a:b].reset_index(drop=True)
            if b >= len(part):
                break
            a = b


def added_up(df: DataFrame, make: Callable[[pd.DataFrame], np.ndarray], length: int) -> np.ndarray:
    """The sum of ``make(portion)`` over ``portions`` of all rows: arrays of ``length`` numbers, of which each task sends one.

    What reaches the driver are ``length`` numbers, whatever the rows.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(length)
        for part in portions(parts):
            if len(part):
                total += make(part)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "total": total[at]})

    small_batches(df.sparkSession)
    out = np.zeros(length)
    for r in df.mapInPandas(run, "at long, total double").groupBy("at").agg(F.sum("total").alias("total")).collect():  # length rows at most
        out[r["at"]] = r["total"]
    return out


def flat(arrays: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values of a batch's arrays one after another, the row of each, and its place in its array. Null arrays are empty."""
    rows = [np.asarray(a, float) if a is not None else np.empty(0) for a in arrays]
    lengths = np.array([len(a) for a in rows], np.int64)
    own = np.repeat(np.arange(len(rows)), lengths)
    return np.concatenate(rows) if rows else np.empty(0), own, np.arange(len(own)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
