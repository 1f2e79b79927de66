"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts and unlabelled ones are sampled, each up to a documented number; the words and word beginnings that
tell them apart best are the features of a linear numpy classifier. It minimises the class-prior-corrected risk
prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)), whose second part must not become negative. Then it scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utrflow.llm.segments import END, hashes, joined, lowered, sized, small_batches
from utrflow.plans.storage import written

#: At most so many toxic and unlabelled texts are learnt from, and so many features kept.
MOST_TOXIC, MOST_UNLABELLED, FEATURES = 4000, 8000, 2048
STARTS = (4, 5, 6)
#: A feature is kept if it is more frequent in toxic texts by so many standard errors.
APART = 6.0
#: The class prior is the share of toxic labels times one of these: an estimate too low costs toxic texts with few signs. Which,
#: folds of the sample learnt from tell.
WIDER = (1.0, 1.25, 1.5, 2.0)
FOLDS = 3
CUT = 0.3


def held_out(doc_id: Column) -> Column:
    """The quarter of ids whose labels are never learnt from; a null id isn't in it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs: 32 bits of the hash of each word and of its first 4, 5 and 6 bytes (in lower case)."""
    buf, stops = joined(texts)
    buf = lowered(buf)
    word = ((buf >= 97) & (buf <= 122)) | ((buf >= 48) & (buf <= 57)) | ((buf >= 0x80) & (buf != END))
    edge = np.diff(word.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.searchsorted(stops, starts)
    own, found = [owner], [hashes(buf, starts, ends) >> np.uint64(32)]
    for k in STARTS:
        long = ends - starts >= k
        own.append(owner[long])
        found.append((hashes(buf, starts[long], starts[long] + k) ^ np.uint64((0x5BD1E995 * k & 0xFFFFFFFF) << 32)) >> np.uint64(32))
    return np.concatenate(own), np.concatenate(found).astype(np.uint32)


class Selected:
    """The features kept, found by a table of 16 bits before they are searched for."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys.astype(np.uint32))
        self.may = np.zeros(1 << 16, bool)
        self.may[self.keys & 0xFFFF] = True

    def pairs(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The distinct (text, place of a feature) pairs."""
        owner, found = _features(texts)
        own = self.may[found & 0xFFFF]
        owner, found = owner[own], found[own]
        at = np.minimum(np.searchsorted(self.keys, found), max(0, len(self.keys) - 1))
        hit = self.keys[at] == found if len(self.keys) else np.zeros(0, bool)
        both = np.unique(owner[hit] * len(self.keys) + at[hit]) if len(self.keys) else np.empty(0, np.int64)
        return both // max(1, len(self.keys)), both % max(1, len(self.keys))


def train(toxic: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 20, rate: float = 0.02, shrink: float = 1e-4, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear model: Adam on the non-negative risk with the logistic loss. Rows are 0/1 features."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(toxic.shape[1]), float(np.log(prior / (1 - prior)))
    m, v, step = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0
    half = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    loss = lambda z: np.logaddexp(0, -z)
    parts = max(1, len(unlabelled) // 512)
    for _ in range(rounds):
        for p, u in zip(np.array_split(rng.permutation(len(toxic)), parts), np.array_split(rng.permutation(len(unlabelled)), parts), strict=True):
            if not len(p) or not len(u):
                continue
            x, y = toxic[p].astype(np.float64), unlabelled[u].astype(np.float64)
            zx, zy = x @ w + b, y @ w + b
            negative = loss(-zy).mean() - prior * loss(-zx).mean()
            gx, gy = half(zx) / len(p), half(zy) / len(u)  # of the losses with label -1
            if negative >= 0:
                dx, dy = -prior * half(-zx) / len(p) - prior * gx, gy
            else:  # the estimate has gone below what a risk can be: step back from it
                dx, dy = prior * gx, -gy
            g = np.append(x.T @ dx + y.T @ dy + shrink * w, dx.sum() + dy.sum())
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w, b = w - move[:-1], b - move[-1]
    return w, b


def likeliest_prior(toxic: np.ndarray, unlabelled: np.ndarray, share: float, factors: tuple[float, ...] = WIDER, folds: int = FOLDS) -> float:
    """The share times the factor by which models learnt from the other folds tell a fold's texts apart best.

    What is compared is the part of the fold's toxic texts that such a model catches, less the part that it flags of its other
    texts: of the unlabelled ones it flags that many and, by the share, the toxic ones among them. No other labels are used.
    The first of equals; the first of all where a fold has no texts.
    """
    priors = [min(0.5, max(0.001, f * share)) for f in factors]
    if min(len(toxic), len(unlabelled)) < folds or len(set(priors)) == 1:
        return priors[0]
    own, other = np.arange(len(toxic)) % folds, np.arange(len(unlabelled)) % folds
    gains = []
    for prior in priors:
        caught, flagged = [], []
        for k in range(folds):
            w, b = train(toxic[own != k], unlabelled[other != k], prior)
            over = [(1 / (1 + np.exp(-np.clip(x.astype(np.float64) @ w + b, -500, 500))) >= CUT).mean() for x in (toxic[own == k], unlabelled[other == k])]
            caught.append(over[0])
            flagged.append((over[1] - share * over[0]) / (1 - share))
        gains.append(np.mean(caught) - np.mean(flagged))
    return priors[int(np.argmax(gains))]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic", most_toxic: int = MOST_TOXIC, most_unlabelled: int = MOST_UNLABELLED, features: int = FEATURES) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias) learnt from rows that aren't held out.

    The toxic and the unlabelled texts are those with the smallest hashes of their ids, up to ``most_toxic`` and
    ``most_unlabelled``; the class prior is the share of toxic rows among all labels that aren't held out, times the factor
    that ``likeliest_prior`` finds within the sample (0.001 to 0.5).
    Labels of unlabelled texts are not looked at. Null labels and ids don't count. Without any toxic text the model is
    the prior alone.
    """
    small_batches(docs.sparkSession)
    order = [F.xxhash64("id"), F.col("id")]
    known = labels.select(F.col(id_col).alias("id"), F.col(label).alias("label")).filter("id is not null and label is not null").filter(~held_out(F.col("id")))
    share = known.agg(F.avg((F.col("label") == 1).cast("double"))).first()[0]
    share = min(0.5, max(0.001, share or 0.0))
    toxic = known.filter("label = 1").select("id").distinct().orderBy(order).limit(most_toxic)
    other = docs.select(F.col(id_col).alias("id")).filter("id is not null").filter(~held_out(F.col("id"))).distinct().orderBy(order).limit(most_unlabelled)
    drawn = toxic.withColumns({"p": F.lit(1), "u": F.lit(0)}).union(other.withColumns({"p": F.lit(0), "u": F.lit(1)})).groupBy("id").agg(F.max("p").alias("p"), F.max("u").alias("u"))
    kind, arrow = docs.schema[id_col].dataType.simpleString(), docs.select(id_col).limit(0).toArrow().schema.field(0).type

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in sized(batches):
            owner, found = _features(texts)
            both = np.unique(owner.astype(np.uint64) << np.uint64(32) | found)
            parts = np.split((both & np.uint64(0xFFFFFFFF)).astype("<u4"), np.searchsorted(both >> np.uint64(32), np.arange(1, len(texts)).astype(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, arrow), pa.array([x.tobytes() for x in parts], pa.binary())], ["id", "found"])

    own = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(drawn.select("id")), "id")  # at most most_toxic + most_unlabelled ids
    sample = written(own.select("id", "text").mapInArrow(sets, f"id {kind}, found binary").groupBy("id").agg(F.min("found").alias("found")).join(F.broadcast(drawn), "id"), "sample")
    n_toxic, n_other = sample.agg(F.sum("p"), F.sum("u")).first()
    if not n_toxic or not n_other:
        return np.empty(0, np.uint32), np.empty(0), float(np.log(share / (1 - share)))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [np.frombuffer(x, "<u4") for x in b["found"].to_pylist()]
            n = [len(x) for x in got]
            keys, at = np.unique(np.concatenate(got), return_inverse=True)
            p, u = (np.bincount(at, weights=np.repeat(b[c].to_numpy(), n), minlength=len(keys)).astype(np.int64) for c in ("p", "u"))
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(p), pa.array(u)], ["feature", "p", "u"])

    rates = sample.select("found", "p", "u").mapInArrow(counts, "feature long, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).filter("p + u >= 8")
    among = (F.col("p") + F.col("u") + 1) / (n_toxic + n_other + 2)
    apart = (F.col("p") / n_toxic - F.col("u") / n_other) / F.sqrt(among * (1 - among) * F.lit(1 / n_toxic + 1 / n_other))
    keys = np.array([r[0] for r in rates.filter(apart > APART).orderBy(apart.desc(), "feature").limit(features).select("feature").collect()], np.int64).astype(np.uint32)
    chosen = Selected(keys)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.packbits(np.isin(chosen.keys, np.frombuffer(x, "<u4"), kind="sort")).tobytes() for x in b["found"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["id"], b["p"], b["u"], pa.array(rows, pa.binary())], ["id", "p", "u", "bits"])

    table = sample.mapInArrow(bits, f"id {kind}, p int, u int, bits binary").orderBy("id").toArrow()
    dense = np.unpackbits(np.frombuffer(b"".join(table["bits"].to_pylist()), np.uint8).reshape(table.num_rows, -1), axis=1)[:, : len(keys)]
    known, rest = dense[table["p"].to_numpy() == 1], dense[table["u"].to_numpy() == 1]
    w, b = train(known, rest, likeliest_prior(known, rest, share))
    return chosen.keys, w, b


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: its id, held_out, score (0 to 1), predicted (1 from 0.3 on).

    Only the text is looked at. Null and empty texts have no features: they get the model's bias. Ids may be null or
    repeat; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind, arrow = docs.schema[id_col].dataType.simpleString(), docs.select(id_col).limit(0).toArrow().schema.field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, w, b = shared.value
        chosen = Selected(keys)
        for ids, texts in sized(batches):
            owner, at = chosen.pairs(texts)
            z = b + np.bincount(owner, weights=w[at], minlength=len(texts))
            yield pa.RecordBatch.from_arrays([pa.array(ids, arrow), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["id", "score"])

    scored = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text") -> DataFrame:
    """``docs`` without those that the model predicts to be toxic; all columns as they were."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(column):
        import pandas as pd

        keys, w, b = shared.value
        chosen = Selected(keys)
        z = []
        for _, texts in sized([pa.RecordBatch.from_arrays([pa.array(range(len(column))), pa.array(column, pa.string())], ["n", "text"])]):
            owner, at = chosen.pairs(texts)
            z.append(b + np.bincount(owner, weights=w[at], minlength=len(texts)))
        return pd.Series(1 / (1 + np.exp(-np.clip(np.concatenate(z), -500, 500)))) if z else pd.Series([], dtype="float64")

    return docs.filter(scores(F.col(f"`{text}`")) < CUT)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
