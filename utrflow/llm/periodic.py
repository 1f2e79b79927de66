"""Periodic runs of words, found on a harmonic grid.

A run of period q and at least 2 q words covers two neighbouring points of the grid 0, q, 2 q, ... So for every period and
grid point at once, numpy searches how far the words from a point on agree with those q later, and likewise backwards, by
bisection over prefix hashes: n/1 + n/2 + ... points for a text of n words, in blocks of bounded size. Runs found from
several points or as multiples of their period are made one, and their words are compared themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utrflow.llm.segments import END, hashes, joined, mixed, ragged, sized, small_batches

#: A run has at least so many words, and two periods.
LEAST = 12
#: So many (period, grid point) pairs are looked at together.
BLOCK = 1 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(9, 14), END]] = True
#: Prime moduli and bases of the prefix hashes; products of two residues fit into 64 bits.
_FIELDS = ((2**31 - 1, 1_103_515_245), (2**31 - 19, 1_664_525_013))


def _powers(n: int, base: int, prime: int) -> np.ndarray:
    """base^0 ... base^n modulo a prime, by doubling."""
    out = np.ones(n + 1, np.uint64)
    have = 1
    while have <= n:
        more = min(have, n + 1 - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, prime)) % np.uint64(prime)
        have += more
    return out


class Prefixes:
    """Hashes of all prefixes of a sequence of word hashes: equal stretches are told by a few operations, whatever their length."""

    def __init__(self, words: np.ndarray):
        self.tables = []
        for prime, base in _FIELDS:
            power = _powers(len(words), base, prime)
            sums = np.zeros(len(words) + 1, np.uint64)
            np.cumsum(mixed(words + np.uint64(base)) % np.uint64(prime) * power[:-1] % np.uint64(prime), out=sums[1:])
            self.tables.append((np.uint64(prime), power, sums % np.uint64(prime)))

    def same(self, at: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from ``at`` on are those from ``at + q`` on."""
        out = np.ones(len(at), bool)
        for p, power, sums in self.tables:
            out &= (sums[at + n] + p - sums[at]) % p * power[q] % p == (sums[at + q + n] + p - sums[at + q]) % p
        return out

    def extent(self, at: np.ndarray, q: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """The greatest n up to ``most`` for which n words from ``at`` on (or, ``back``, before it) equal those q later."""
        low, high = np.zeros(len(at), np.int64), most.copy()
        while (todo := low < high).any():
            middle = (low + high + 1) // 2
            hit = self.same(at - middle if back else at, q, middle)
            low, high = np.where(todo & hit, middle, low), np.where(todo & ~hit, middle - 1, high)
        return low


def _grid(first: np.ndarray, n: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, period, point) of all grids of texts with ``n`` words from ``first`` on, in blocks; both ends of a pair are in the text."""
    half = n // 2
    text = np.repeat(np.arange(len(n)), half)
    period = ragged(np.ones(len(n), np.int64), half)
    points = (n[text] - 1) // period
    until = np.cumsum(points)
    a = done = 0
    while a < len(text):
        # a text's period that has more points than a block holds is a block of its own: never more than the text's words
        b = max(a + 1, int(np.searchsorted(until, done + block, "right")))
        own = points[a:b]
        q = np.repeat(period[a:b], own)
        of = np.repeat(text[a:b], own)
        yield of, q, first[of] + ragged(np.zeros(b - a, np.int64), own) * q
        a, done = b, int(until[b - 1])


def _stretches(words: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of one text's runs by comparing its words with themselves at each shift; for texts whose hashes misled."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(words) // 2 + 1):
        edge = np.diff((words[:-q] == words[q:]).astype(np.int8), prepend=0, append=0)
        for s, e in zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) + q).tolist(), strict=True):
            if e - s >= max(least, 2 * q):
                found.setdefault((s, e), q)
    return [(s, e, q) for (s, e), q in found.items()]


def runs_of(texts: list[bytes], least: int = LEAST, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The number of words of each text; rows (text, start, length, period) of all runs by text, start and period."""
    buf, stops = joined(texts)
    edge = np.diff((~_BLANK[buf]).astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = np.bincount(np.searchsorted(stops, starts), minlength=len(texts))
    first = np.cumsum(n) - n
    words = hashes(buf, starts, ends)
    prefixes = Prefixes(words)
    found = [np.empty((0, 4), np.int64)]
    stop = first + n
    equal = np.empty(0, bool)
    for of, q, at in _grid(first, np.where(n >= least, n, 0), block):
        equal = words[at] == words[at + q]
        # max(least, 2 q) - q >= least / 2 words in a row equal those q later, so one beside an equal pair does, too
        after, before = at + q + 1 < stop[of], at > first[of]
        near = np.zeros(len(at), bool)
        if least >= 4:
            own = np.flatnonzero(equal & after)
            near[own] = words[at[own] + 1] == words[at[own] + q[own] + 1]
            own = np.flatnonzero(equal & before & ~near)
            near[own] |= words[at[own] - 1] == words[at[own] + q[own] - 1]
        else:
            near = equal
        of, q, at = (x[near] for x in (of, q, at))
        seen = at - q >= first[of]  # where the period before agrees too, the point before it finds the run
        seen[seen] = prefixes.same(at[seen] - q[seen], q[seen], q[seen])
        of, q, at = (x[~seen] for x in (of, q, at))
        forth = prefixes.extent(at, q, stop[of] - at - q, False)
        s = at - prefixes.extent(at, q, at - first[of], True)
        length = at + q + forth - s
        long = length >= np.maximum(least, 2 * q)
        found.append(np.stack([of, s, length, q], axis=1)[long])
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, 1:3] != rows[:-1, 1:3]).any(axis=1)  # the smallest period of a stretch stands first
    rows = rows[new]
    rows = _verified(rows, buf, starts, ends, first, n, texts, least)
    return n, rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _verified(rows: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, n: np.ndarray, texts: list[bytes], least: int) -> np.ndarray:
    """``rows`` with starts counted within the texts. All words of all runs are compared; a text whose hashes misled is done anew, word by word."""
    of = np.repeat(np.arange(len(rows)), rows[:, 2] - rows[:, 3])
    at = ragged(rows[:, 1], rows[:, 2] - rows[:, 3])
    later = at + rows[of, 3]
    wrong = ends[at] - starts[at] != ends[later] - starts[later]
    step = 1 << 18
    for a in range(0, len(at), step):  # bytes of so many words together
        x, y = at[a : a + step], later[a : a + step]
        length = np.where(wrong[a : a + step], 0, ends[x] - starts[x])
        differ = buf[ragged(starts[x], length)] != buf[ragged(starts[y], length)]
        if differ.any():
            wrong[a + np.unique(np.repeat(np.arange(len(x)), length)[differ])] = True
    out = rows.copy()
    out[:, 1] -= first[rows[:, 0]]
    if not wrong.any():
        return out
    again = np.unique(rows[of[wrong], 0])
    out = out[~np.isin(out[:, 0], again)]
    for t in again.tolist():
        seen: dict[bytes, int] = {}
        exact = np.array([seen.setdefault(w, len(seen)) for w in texts[t].split()])
        out = np.concatenate([out, np.array([(t, s, e - s, q) for s, e, q in _stretches(exact, least)], np.int64).reshape(-1, 4)])
    return out.astype(np.int64)


def collapsed_texts(texts: list[bytes], n: np.ndarray, rows: np.ndarray) -> list[bytes]:
    """Each text's words joined by single blanks, without those that a run holds after its first period."""
    first = np.cumsum(n) - n
    cover = np.zeros(int(n.sum()) + 1, np.int64)
    np.add.at(cover, first[rows[:, 0]] + rows[:, 1] + rows[:, 3], 1)
    np.add.at(cover, first[rows[:, 0]] + rows[:, 1] + rows[:, 2], -1)
    kept = (np.cumsum(cover[:-1]) == 0).tolist()
    with_runs, out = set(np.unique(rows[:, 0]).tolist()), []
    for t, text in enumerate(texts):
        words = text.split()  # of bytes: at blanks and 0x09 to 0x0D, as above
        out.append(b" ".join(compress(words, kept[first[t] : first[t] + n[t]]) if t in with_runs else words))
    return out


def find_runs(docs: DataFrame, text: str = "text", id_col: str = "doc_id", least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """(id, n_words, runs, collapsed) for each row: its runs by start and period, and its text without their repetitions.

    Words are what blanks and the characters 0x09 to 0x0D part. A run is a stretch with smallest period q, at least
    max(``least``, 2 q) words long, that no neighbouring word extends. Null and empty texts have no words, no runs and an
    empty collapsed text. Ids may be null or repeat, further columns are left out, an empty table gives no rows. Each text
    is looked at by itself: no shuffle, and memory beyond the text is bounded by ``block`` and its own length.
    """
    small_batches(docs.sparkSession)
    kind, arrow = docs.schema[id_col].dataType.simpleString(), docs.select(id_col).limit(0).toArrow().schema.field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in sized(batches):
            n, rows = runs_of(texts, least, block)
            offsets = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1)).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in (1, 2, 3)], ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, arrow), pa.array(n), found, pa.array(collapsed_texts(texts, n, rows), pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string").withColumnRenamed("id", id_col)


def planted(text: Column, doc_id: Column) -> Column:
    """The text in which one id of ten (by crc32) has its words from some place on replaced by a repetition of the first few of them."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def rewritten(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")).otherwise(text)

    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    return F.when(h % 10 == 0, F.transform(F.array(words), rewritten)[0]).otherwise(text)


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    found = find_runs(docs).withColumns({"best": best, "lines": lines})
    length, period = F.col("best.length"), -F.col("best.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")
    )
