"""Spelling variants: words at edit distance one, and the frequent form that a rare one goes back to.

The vocabulary is joined with itself through tries. A pair that differs by one edit has the first half of the shorter word
in common, or else its second half, so words are dealt out by their halves: each trie holds what follows the first half, or
what stands before the second half read backwards. Down a trie go the sets of active nodes: for each node those that one
replacement, or one insertion, turns it into. Where both nodes of a pair end a word, the pair is near.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utrflow.llm.segments import ragged
from utrflow.plans.storage import release, written

#: Letters of a word, the least number of them, and of occurrences.
LETTERS, SHORTEST, LEAST = "A-Za-z\\u00C0-\\u00FF", 7, 2
#: A form has at least so many times a word's occurrences.
TIMES = 10
#: About so many rows are joined in one trie task; a half that more words (or a thousandth of all) share goes another way.
ROWS = 100_000
_LABELS = 1 << 21


def occurrences(docs: DataFrame, word: Column | None = None, text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """(word, n): the distinct words of all texts that have at least ``shortest`` letters. Null texts have none.

    Words are maximal runs of letters with A-Z lowered; ``word`` may make another of each (from a column named ``word``).
    Counts are added up before they are shuffled.
    """
    # a shorter run can't give a long word, and what the pattern finds is maximal: it takes all letters from the first on
    runs = docs.select("*", F.explode(F.regexp_extract_all(F.col(text), F.lit(f"([{LETTERS}]{{{shortest},}})"), F.lit(1))).alias("__run"))
    runs = runs.withColumn("word", F.translate("__run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return runs.select((F.col("word") if word is None else word).alias("word")).filter(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


class Trie:
    """Levels of the tries of sorted (group, tail) rows, one at a time; a group's root is a node of level 0."""

    def __init__(self, groups: np.ndarray, tails: list[str]):
        self.codes = np.frombuffer("".join(tails).encode("utf-32-le"), "<u4").astype(np.int64)
        self.lengths = np.fromiter(map(len, tails), np.int64, len(tails))
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.depth = 0
        self.rows = np.arange(len(tails))  # of the tails that reach this level
        new = np.diff(groups, prepend=-1) != 0
        self.node = np.cumsum(new) - 1  # of each of these rows
        self.keys = np.arange(int(new.sum())) * _LABELS  # parent and label of each node, ascending
        self._end()

    def _end(self) -> None:
        self.ends = np.full(len(self.keys), -1)  # the row that ends at each node
        own = self.lengths[self.rows] == self.depth
        self.ends[self.node[own]] = self.rows[own]

    def below(self) -> Trie:
        """The next level."""
        out = object.__new__(Trie)
        out.codes, out.lengths, out.offsets, out.depth = self.codes, self.lengths, self.offsets, self.depth + 1
        go = self.lengths[self.rows] > self.depth
        out.rows = self.rows[go]
        keys = self.node[go] * _LABELS + self.codes[self.offsets[out.rows] + self.depth]
        new = np.diff(keys, prepend=-1) != 0
        out.node, out.keys = np.cumsum(new) - 1, keys[new]
        out._end()
        return out


def _matched(x: np.ndarray, y: np.ndarray, below_x: Trie, below_y: Trie) -> np.ndarray:
    """The pairs of children with the same label of each pair (x, y); ``below_x`` and ``below_y`` hold the children."""
    first = np.searchsorted(below_x.keys, x * _LABELS)
    many = np.searchsorted(below_x.keys, (x + 1) * _LABELS) - first
    child = ragged(first, many)
    want = np.repeat(y, many) * _LABELS + below_x.keys[child] % _LABELS
    at = np.minimum(np.searchsorted(below_y.keys, want), max(0, len(below_y.keys) - 1))
    hit = below_y.keys[at] == want if len(below_y.keys) else np.zeros(len(want), bool)
    return np.stack([child[hit], at[hit]])


def near_rows(groups: np.ndarray, tails: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Rows (a, b) of one group whose tails are one edit apart, and whether b is longer. Rows ascend by group, then tail, and are distinct.

    Level by level: ``replaced`` holds the active pairs of nodes of this level that differ in one label, ``inserted`` those of
    a node of this level and one of the next that has one label more.
    """
    if not len(groups):
        return
    here = Trie(groups, tails)
    below = here.below()
    replaced = inserted = np.empty((2, 0), np.int64)
    while len(here.rows):
        both = here.ends[replaced]
        both = both[:, (both >= 0).all(axis=0)]
        yield both[0], both[1], False
        # any node is an insertion away from its children; what comes down from the level above may be the same pair
        parent = below.keys // _LABELS
        pairs = np.unique(np.concatenate([inserted[0] * len(below.keys) + inserted[1], parent * len(below.keys) + np.arange(len(parent))])) if len(parent) else np.empty(0, np.int64)
        inserted = np.stack(np.divmod(pairs, max(1, len(below.keys))))
        x, y = here.ends[inserted[0]], below.ends[inserted[1]]
        both = (x >= 0) & (y >= 0)
        yield x[both], y[both], True
        next_below = below.below()
        # children of one node replace each other
        later = np.searchsorted(parent, parent, "right") - np.arange(len(parent)) - 1
        first = np.repeat(np.arange(len(parent)), later)
        siblings = np.stack([first, ragged(np.arange(1, len(parent) + 1), later)])
        replaced = np.concatenate([_matched(replaced[0], replaced[1], below, below), siblings], axis=1)
        inserted = _matched(inserted[0], inserted[1], below, next_below)
        here, below = below, next_below


def near_pairs(words: DataFrame, rows: int = ROWS) -> DataFrame:
    """(word, n, near, near_n): each two words of ``words`` (word, n) that one inserted, deleted or replaced code point parts, once.

    Words are distinct, of two code points or more; an empty table gives no rows. Each word is dealt out four times: as
    the shorter of a pair and as the longer, by the first half of the shorter and by the second. Halves that more than
    ``rows`` words share (or a thousandth of all, if that is more) are joined by what is left of a word without one of
    its letters, which no more words share than there are letters.
    """
    spark = words.sparkSession
    both = F.array(F.struct(F.lit(True).alias("short"), F.length("word").alias("size")), F.struct(F.lit(False).alias("short"), (F.length("word") - 1).alias("size")))
    dealt = words.select("word", "n", F.inline(both)).filter("size > 0").withColumn("half", F.expr("size div 2")).select(
        "word", "n", "short", "size", "half",
        F.inline(F.array(
            F.struct(F.lit(True).alias("front"), F.expr("substring(word, 1, half)").alias("root"), F.expr("substring(word, half + 1)").alias("tail")),
            F.struct(F.lit(False).alias("front"), F.expr("right(word, size - half)").alias("root"), F.expr("reverse(left(word, length(word) - size + half))").alias("tail")),
        )),
    )
    group = ["front", "size", "root"]
    sizes = dealt.groupBy(*group).agg(F.count(F.lit(1)).alias("many"))
    total = 4 * words.count()
    hot = F.broadcast(sizes.filter(F.col("many") > max(rows, total // 1000)).select(*group))  # fewer than a thousand rows, or than total / rows
    buckets = max(1, total // rows)

    def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: dict[str, list] = {c: [] for c in ("front", "size", "root", "tail", "word", "n", "short")}
        for b in batches:
            for c, values in cols.items():
                values.extend(b[c].to_pylist())
        order = sorted(range(len(cols["word"])), key=lambda i: (cols["front"][i], cols["size"][i], cols["root"][i], cols["tail"][i]))
        front, size, root, tail, word, n, short = ([cols[c][i] for i in order] for c in ("front", "size", "root", "tail", "word", "n", "short"))
        groups = np.cumsum([i > 0 and (front[i], size[i], root[i]) != (front[i - 1], size[i - 1], root[i - 1]) for i in range(len(word))])
        for x, y, longer in near_rows(groups, tail):
            # two longer words are of another size's group; what the first half shows the second needn't show again
            own = [(i, j) for i, j in zip(x.tolist(), y.tolist(), strict=True) if short[i] and short[j] != longer and (front[i] or word[i][: size[i] // 2] != word[j][: size[i] // 2])]
            if own:
                yield pa.RecordBatch.from_arrays([pa.array([word[i] for i, _ in own]), pa.array([n[i] for i, _ in own]), pa.array([word[j] for _, j in own]), pa.array([n[j] for _, j in own])], ["word", "n", "near", "near_n"])

    cold = dealt.join(hot, group, "left_anti").withColumn("bucket", F.pmod(F.xxhash64(*group), F.lit(buckets)))
    found = cold.select("bucket", *group, "tail", "word", "n", "short").groupBy("bucket").applyInArrow(lambda table: _table(tries(table.to_batches())), _PAIRS)
    many = written(dealt.join(hot, group, "left_semi"), "shared-halves")
    if many.isEmpty():
        release(many)
        return found
    return found.unionByName(_without_one(many, group))


_PAIRS = "word string, n long, near string, near_n long"


def _table(batches: Iterator[pa.RecordBatch]) -> pa.Table:
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])
    return pa.Table.from_batches([b.cast(schema) for b in batches], schema)


def _without_one(dealt: DataFrame, group: list[str]) -> DataFrame:
    """The near pairs of halves shared by very many words: exact joins on what is left without the letter at a place."""
    left = dealt.withColumn("at", F.explode(F.sequence(F.lit(1), F.greatest(F.length("tail"), F.lit(1))))).filter("length(tail) > 0").withColumn("rest", F.expr("concat(left(tail, at - 1), substring(tail, at + 1))"))
    short = left.filter("short").select(*group, "at", "rest", "word", "n")
    other = short.withColumnsRenamed({"word": "near", "n": "near_n"})
    replaced = short.join(other, [*group, "at", "rest"]).filter("word < near").select("word", "n", "near", "near_n")
    longer = left.filter("not short").select(*group, F.col("rest").alias("tail"), F.col("word").alias("near"), F.col("n").alias("near_n")).distinct()
    inserted = dealt.filter("short").join(longer, [*group, "tail"]).filter("front or left(word, half) != left(near, half)").select("word", "n", "near", "near_n")
    return replaced.unionByName(inserted)


def group_variants(words: DataFrame, times: int = TIMES, rows: int = ROWS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each word of ``words`` (word, n), distinct.

    A word's form is the near word with the greatest n (of equals the first in code-point order), if that is at least
    ``times`` the word's own; root follows the forms to the last. Each step multiplies n by ``times``, so nineteen steps
    exhaust a long, and links are doubled five times at most, each time with a join of the words that have a form.
    """
    pairs = near_pairs(words, rows)
    sides = pairs.select(F.inline(F.array(F.struct("word", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))))
    best = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best"))
    chosen = (-F.col("best.rank") >= times * F.col("n")) & F.col("best").isNotNull()
    table = written(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(chosen, F.col("best.near")).alias("form"), F.when(chosen, -F.col("best.rank")).alias("form_n")), "variants")
    links = table.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(5):
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = not step.filter("moved").isEmpty()
        links = step.select("word", "root")
        if not moved:
            break
    return table.join(links, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def misspelt(doc_id: Column, word: Column) -> Column:
    """The word without one of its letters, where 31 divides the crc32 of "id:word"; else the word. A null id counts as empty."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word))
    at = (h % F.length(word)).cast("int")
    return F.when(h % 31 == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    words = written(occurrences(docs, misspelt(F.col("doc_id"), F.col("word"))).filter(F.col("n") >= LEAST), "vocabulary")
    return group_variants(words).select("word", "form", "root", "n", "n_near", "form_n")
