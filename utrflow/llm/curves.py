"""Approximate nearest neighbours along shifted Hilbert curves.

Unit vectors are projected (a seeded orthonormal projection for each curve), shifted, and ordered by their Hilbert keys. Each
curve's order is cut into blocks of nearly equal numbers of rows by quantiles of the keys; a query meets the blocks within
its window on every curve, each block gives its best rows with exact cosines, and the best of all blocks are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from utrflow.llm.segments import small_batches
from utrflow.plans.storage import written

CURVES, AXES, BITS = 16, 16, 3
#: A window holds this share of all rows on each curve, and at least so many rows. Isotropic vectors need as much for a
#: recall of 0.9; clustered ones would do with less.
SHARE, LEAST = 0.06, 2000
#: Blocks of an order: at least so many; a block has at most about BLOCK rows, and meets so many queries at once.
BLOCKS, BLOCK, ASKING = 64, 20_000, 20_000


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of cell coordinates (0 to 2^bits - 1), for at most 62 bits in all.

    The coordinates are turned into the transposed form of the index (Skilling 2004) and their bits interleaved.
    """
    x = [c.astype(np.int64) for c in cells.T]
    axes = len(x)
    for level in range(bits - 1, 0, -1):
        top, low = 1 << level, (1 << level) - 1
        for i in range(axes):
            on = (x[i] & top) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
    for i in range(1, axes):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where((x[-1] & (1 << level)) != 0, turn ^ ((1 << level) - 1), turn)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = key << 1 | ((x[i] ^ turn) >> b & 1)
    return key


def curve_keys(unit: np.ndarray, ids: np.ndarray, curve: int) -> np.ndarray:
    """48-bit keys with 15 bits of the id's hash below them, so that equal vectors can be cut apart."""
    rng = np.random.default_rng([11, curve, unit.shape[1]])
    axes = min(AXES, unit.shape[1])
    frame = np.linalg.qr(rng.normal(size=(unit.shape[1], axes)))[0]
    spread = np.clip(unit @ frame * np.sqrt(unit.shape[1]) / 6 + 0.5, 0, 1 - 1e-9)  # +-3 deviations of a random direction
    cells = ((spread + rng.random(axes)) / 2 * (1 << BITS)).astype(np.int64)
    tie = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)
    return hilbert_keys(cells, BITS) << 15 | tie.astype(np.int64)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two that brings its largest component next to 1: squares then neither vanish nor overflow.

    Cosines stay the same to the last bit.
    """
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _vectors(batch: pa.RecordBatch, kind: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, ids, vectors) of a batch with id, dim and vec."""
    dims = batch["dim"].to_numpy()
    for d in np.unique(dims).tolist():
        own = batch.filter(pa.array(dims == d))
        yield d, own["id"].to_numpy(), _scaled(np.frombuffer(b"".join(own["vec"].to_pylist()), kind).reshape(-1, d).astype(np.float64))


def nearest(df: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest rows found for each row whose id is divisible by ``every``.

    Vectors that are null, empty or zero or hold null or non-finite components take no part, nor do rows with a null id; a
    query only meets vectors of its own length. Nearest first, ties to the smaller id. Of equal vectors only the k + 1 with
    the smallest ids are searched (no query can have another among its k nearest). Rows with a repeated id count once, with
    their best score. Other columns aren't read. An empty table gives no rows.
    """
    spark = df.sparkSession
    small_batches(spark)
    wide = df.schema[vector].dataType.elementType.simpleString() != "float"
    kind = "<f8" if wide else "<f4"

    def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, dims, out = [], [], []
            for i, v in zip(b["id"].to_pylist(), b["v"], strict=True):
                x = np.array([np.nan if c is None else c for c in v.as_py()], kind)
                if len(x) and np.isfinite(x).all() and x.any():
                    ids.append(i)
                    dims.append(len(x))
                    out.append((x + 0.0).tobytes())  # no negative zeros
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["id", "dim", "vec"])

    given = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")).filter("id is not null and v is not null")
    rows = written(given.mapInArrow(usable, "id long, dim int, vec binary"), "vectors")
    index = written(rows.dropDuplicates(["id", "vec"]).withColumn("n", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).filter(F.col("n") <= k + 1).drop("n"), "index")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, ids, x in _vectors(b, kind):
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                for c in range(CURVES):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), d, np.int32)), pa.array(np.full(len(ids), c, np.int32)), pa.array(curve_keys(unit, ids, c))], ["dim", "curve", "key"])

    counts = {r["dim"]: r["n"] for r in index.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    asked = {r["dim"]: r["n"] for r in rows.filter(F.col("id") % every == 0).groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    blocks = {d: max(1, min(n, max(BLOCKS, -(-n // BLOCK)))) for d, n in counts.items()}
    reach = {d: int(np.ceil(max(share, least / counts[d]) * blocks[d] / 2)) for d in counts}
    turns = {d: max(1, -(-asked.get(d, 0) * min(blocks[d], 2 * reach[d] + 1) // blocks[d] // ASKING)) for d in counts}
    keys, bounds = index.mapInArrow(keyed, "dim int, curve int, key long"), {}
    for d, n in blocks.items():
        at = [i / n for i in range(1, n)]
        cut = keys.filter(F.col("dim") == d).groupBy("curve").agg(F.percentile_approx("key", at or [0.5], 100 * n).alias("at"))
        bounds |= {(d, r["curve"]): np.array(r["at"] if at else [], np.int64) for r in cut.collect()}
    shared = spark.sparkContext.broadcast((bounds, blocks, reach, turns))
    names = ["dim", "curve", "block", "turn", "asks", "id", "vec"]

    def placed(asks: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bounds, blocks, reach, turns = shared.value
            for b in batches:
                for d, ids, x in _vectors(b, kind):
                    if d not in blocks:
                        continue
                    unit, raw = x / np.linalg.norm(x, axis=1, keepdims=True), x.astype(kind)  # scaled: the direction is all that counts
                    for c in range(CURVES):
                        home = np.searchsorted(bounds[d, c], curve_keys(unit, ids, c), "right")
                        if asks:
                            # windows keep their width at the ends of the curve
                            width = min(blocks[d], 2 * reach[d] + 1)
                            first = np.clip(home - reach[d], 0, blocks[d] - width)
                            who, block, turn = np.repeat(np.arange(len(ids)), width), (first[:, None] + np.arange(width)).ravel(), np.repeat(ids % (turns[d] * every) // every, width)
                        else:
                            who, block, turn = np.repeat(np.arange(len(ids)), turns[d]), np.repeat(home, turns[d]), np.tile(np.arange(turns[d]), len(ids))
                        for a in range(0, len(who), 8192):
                            w = who[a : a + 8192]
                            n = len(w)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, d, np.int32)), pa.array(np.full(n, c, np.int32)), pa.array(block[a : a + n].astype(np.int64)), pa.array(turn[a : a + n].astype(np.int64)), pa.array(np.full(n, asks)), pa.array(ids[w]), pa.array([raw[i].tobytes() for i in w.tolist()], pa.binary())], names)

        return run

    def best(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, parts = key[0].as_py(), {True: ([], []), False: ([], [])}
        for b in batches:
            asks = b["asks"].to_numpy(zero_copy_only=False)
            for flag in (True, False):
                own = b.filter(pa.array(asks == flag))
                parts[flag][0].append(own["id"].to_numpy())
                parts[flag][1].append(np.frombuffer(b"".join(own["vec"].to_pylist()), kind).reshape(-1, d).astype(np.float64))
        (q_ids, q), (x_ids, x) = ((np.concatenate(a), _scaled(np.concatenate(b))) for a, b in (parts[True], parts[False]))
        if not len(q_ids) or not len(x_ids):
            return
        xn = np.sqrt((x * x).sum(axis=1))
        unit = x / xn[:, None]
        out: list[tuple] = []
        for a in range(0, len(q_ids), 128):
            some = q[a : a + 128]
            qn = np.sqrt((some * some).sum(axis=1))
            near = (some / qn[:, None]) @ unit.T
            near[q_ids[a : a + 128, None] == x_ids[None, :]] = -np.inf
            m = min(k, len(x_ids))
            floor = -np.partition(-near, m - 1, axis=1)[:, m - 1] - 1e-9
            i, j = np.nonzero((near >= floor[:, None]) & np.isfinite(near))
            score = (some[i] * x[j]).sum(axis=1) / (qn[i] * xn[j])
            order = np.lexsort((x_ids[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            keep = place < k
            out.append((q_ids[a + i[keep]], x_ids[j[keep]], score[keep]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    schema = "dim int, curve int, block long, turn long, asks boolean, id long, vec binary"
    met = index.mapInArrow(placed(False), schema).union(rows.filter(F.col("id") % every == 0).mapInArrow(placed(True), schema))
    found = met.groupBy("dim", "curve", "block", "turn").applyInArrow(best, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
