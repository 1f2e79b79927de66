"""Bounded-space online packing of documents' tokens into sequences.

Each task keeps a fixed number of open windows. A document's whole windows are emitted as they are; its rest goes to the
open window that it fills best. When it fits in none, the fullest is filled up from it and emitted, and what remains of it
is placed again. A task's last windows are cut anew into full ones; what is left over (less than a window) goes, with its
ids, to a second round that merges the leftovers of up to 256 tasks in the same way.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utrflow.llm.agenda import Merges
from utrflow.llm.segments import END, IdCache, joined, ragged, sized, small_batches
from utrflow.plans.storage import written

WINDOW, OPEN, MERGED_TASKS = 1024, 64, 256
LETTER, NUMBER, SPACE, OTHER, STOP, UNSEEN = 1, 2, 3, 4, 5, 0


class ByteLevelEncoder:
    """Ids of whole texts by a byte-level BPE file of the tokenizers library, each distinct word merged once.

    The split into words is the usual one for such files (contractions; letters, digits or other signs with the space
    before them; white space). The library itself says of each character, when it first occurs, to which class it belongs.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.cut = tokenizer.pre_tokenizer.pre_tokenize_str
        whole = json.loads(tokenizer.to_str())
        model = whole["model"]
        # texts are cut at the file's added tokens first, the longest where several begin
        self.added = {t["content"].encode(): t["id"] for t in whole["added_tokens"]}
        self.marks = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + b")") if self.added else None
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right, result = (np.array([vocab[w] for w in words]) for words in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        self.merges = Merges(left, right, np.arange(len(pairs)), result)
        # each byte stands in the vocabulary as a printable character: itself, or the next of those from 256 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = (chr(c) for c in range(0x100, 0x200))
        self.symbols = np.array([vocab[chr(b) if b in plain else next(others)] for b in range(256)])
        self.cache = IdCache(self._ids)
        self.classes = np.zeros(0x110000, np.uint8)
        self._learn(np.arange(128))
        self.ascii = np.zeros(256, np.uint8)
        self.ascii[:128], self.ascii[END] = self.classes[:128], STOP

    def _ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self.merges.run(self.symbols[np.frombuffer(b"".join(words), np.uint8)], np.fromiter(map(len, words), np.int64, len(words)))

    def _learn(self, points: np.ndarray) -> None:
        words = self.cut
        for p in points.tolist():
            c = chr(p)
            # a letter or digit joins its like; a sign takes the space before it, white space doesn't
            self.classes[p] = LETTER if len(words(f"a{c}a")) == 1 else NUMBER if len(words(f"1{c}1")) == 1 else OTHER if len(words(f"! {c}!")) == 2 else SPACE

    def _classes(self, buf: np.ndarray) -> np.ndarray:
        out = self.ascii[buf]
        lead = np.flatnonzero((buf >= 0xC0) & (buf < END))
        if lead.size:
            size = 2 + (buf[lead] >= 0xE0).astype(np.int64) + (buf[lead] >= 0xF0)
            at = lambda k: buf[lead + np.minimum(k, size - 1)].astype(np.int64) & 0x3F
            b = buf[lead].astype(np.int64)
            point = np.select([size == 2, size == 3], [(b & 0x1F) << 6 | at(1), (b & 0x0F) << 12 | at(1) << 6 | at(2)], (b & 0x07) << 18 | at(1) << 12 | at(2) << 6 | at(3))
            if (new := np.unique(point[self.classes[point] == UNSEEN])).size:
                self._learn(new)
            for k in range(4):
                own = size > k
                out[lead[own] + k] = self.classes[point[own]]
        return out

    def words(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = self._classes(buf)
        start = np.empty(len(buf), bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start |= kind == STOP
        after = np.flatnonzero(start[1:] & (kind[:-1] == SPACE) & (kind[1:] != STOP)) + 1  # where white space ends
        last = after - 1
        for _ in range(3):
            last = np.where((buf[last] & 0xC0) == 0x80, last - 1, last)
        start[after[buf[last] == 0x20]] = False
        start[last] = True
        mark = np.flatnonzero((buf == 0x27) & start & (np.append(kind[1:], STOP) == LETTER))
        if mark.size:
            one, two = buf[np.minimum(mark + 1, len(buf) - 1)], buf[np.minimum(mark + 2, len(buf) - 1)]
            short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            for at, n in ((mark[short], 2), (mark[long & ~short], 3)):
                start[at + 1] = False
                start[at + n] = True
        at = np.flatnonzero(start)
        end = np.append(at[1:], len(buf))
        real = kind[at] != STOP
        return at[real], end[real]

    def encode_loaded(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids as the library gives them by the file as it is: added tokens in a text have their own."""
        if self.marks is None or not any(map(self.marks.search, texts)):
            return self.encode(texts)
        parts = [self.marks.split(t) for t in texts]
        between = iter(self.encode([p for own in parts for p in own[::2]]))
        return [np.concatenate([np.array([self.added[p]], np.uint32) if i % 2 else next(between) for i, p in enumerate(own)]) for own in parts]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids with added tokens taken as any other characters."""
        buf, stops = joined(texts)
        starts, ends = self.words(buf)
        if not len(starts):
            return [np.empty(0, np.uint32) for _ in texts]
        inverse, at, ln = self.cache.lookup(buf, starts, ends)
        lengths = ln[inverse]
        ids = self.cache.flat[ragged(at[inverse], lengths)]
        edges = np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(starts, stops)]
        return np.split(ids, edges[:-1])


class Packer:
    """Open windows of one task. A piece is (doc, start, doc_tokens, ids); emit gets (sequence, pieces)."""

    def __init__(self, first: int, emit: Callable[[int, list], None], window: int = WINDOW, most: int = OPEN):
        self.next, self.emit, self.window, self.most = first, emit, window, most
        self.open: list[tuple[int, int]] = []  # (tokens, key), in order
        self.pieces: dict[int, list] = {}
        self.keys = 0

    def _send(self, pieces: list) -> None:
        self.emit(self.next, pieces)
        self.next += 1

    def add(self, doc, start: int, total: int, ids: np.ndarray) -> None:
        while len(ids) >= self.window:
            self._send([(doc, start, total, ids[: self.window])])
            ids, start = ids[self.window :], start + self.window
        while len(ids):
            k = bisect_right(self.open, (self.window - len(ids), 1 << 62)) - 1  # the fullest that still takes all
            if k >= 0:
                filled, key = self.open.pop(k)
            elif len(self.open) < self.most:
                self.keys += 1
                filled, key = 0, self.keys
                self.pieces[key] = []
            else:
                filled, key = self.open.pop()
            part = ids[: self.window - filled]
            self.pieces[key].append((doc, start, total, part))
            filled += len(part)
            ids, start = ids[len(part) :], start + len(part)
            if filled == self.window:
                self._send(self.pieces.pop(key))
            else:
                insort(self.open, (filled, key))

    def close(self) -> list:
        """Cuts the open windows into full ones; gives the pieces that remain, fewer than a window's tokens."""
        rest, self.most = [p for _, key in reversed(self.open) for p in self.pieces[key]], 1
        self.open, self.pieces = [], {}
        for p in rest:
            self.add(*p)
        return self.pieces[self.open[0][1]] if self.open else []


def power_cuts(pieces: list, least: int) -> list[list]:
    """The last pieces in sequences of 2^k tokens, from the largest down to ``least``, then one with what remains."""
    out, left = [], sum(len(p[3]) for p in pieces)
    doc_pieces = list(pieces)
    while left:
        size = 1 << left.bit_length() - 1
        size = size if size >= least else left
        own, need = [], size
        while need:
            d, s, t, ids = doc_pieces.pop(0)
            own.append((d, s, t, ids[:need]))
            if len(ids) > need:
                doc_pieces.insert(0, (d, s + need, t, ids[need:]))
            need -= len(own[-1][3])
        out.append(own)
        left -= size
    return out


class _Rows:
    """Result rows as Arrow batches."""

    def __init__(self, id_type: pa.DataType, with_ids: bool):
        self.id_type, self.with_ids, self.rows = id_type, with_ids, []

    def add(self, sequence: int, pieces: list, keep: bool = False) -> None:
        offset = 0
        for doc, start, total, ids in pieces:
            data = ids.astype("<u4").tobytes()
            self.rows.append((doc, start, len(ids), zlib.crc32(data), total, sequence, offset, data if keep else None, keep))
            offset += len(ids)

    def take(self) -> pa.RecordBatch:
        kinds = [self.id_type, *[pa.int64()] * 6, pa.binary(), pa.bool_()]
        names = ["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "left_over"]
        columns = list(zip(*self.rows, strict=True)) or [[]] * 9
        self.rows = []
        n = 9 if self.with_ids else 7
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:n], kinds[:n], strict=True)], names[:n])


def pack(df: DataFrame, tokenizer: str, text: str = "text", id_col: str = "doc_id", window: int = WINDOW, most_open: int = OPEN, end_id: int = 0) -> DataFrame:
    """One row per piece: the document's id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a byte-level BPE file. Each document's ids are followed by ``end_id``; null and empty
    texts have only that. Ids may be null or repeat: each row is a document of its own. Other columns are not read. An
    empty table gives no rows. Every sequence is full but for the last few of each 256 tasks, which have power-of-two sizes.
    """
    small_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType
    arrow = df.select(F.col(id_col).alias("doc")).limit(0).toArrow().schema.field(0).type

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        encoder, rows = _encoder(tokenizer), _Rows(arrow, True)
        packer = Packer(task << 32, rows.add, window, most_open)
        for docs, texts in sized(batches):
            for doc, ids in zip(docs, encoder.encode_loaded(texts), strict=True):
                packer.add(doc, 0, len(ids) + 1, np.append(ids, np.uint32(end_id)))
            yield rows.take()
        if rest := packer.close():
            rows.add(task, rest, keep=True)
        yield rows.take()

    schema = f"doc {id_type.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, left_over boolean"
    packed = written(df.select(F.col(id_col).alias("doc"), F.col(text).alias("text")).mapInArrow(first, schema), "packed")

    def second(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(list(batches)).sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        rows = _Rows(arrow, False)
        packer = Packer((1 << 62) | key[0].as_py() << 32, rows.add, window, 1)
        for doc, start, total, ids in zip(*(found[c].to_pylist() for c in ("doc", "start", "doc_tokens", "ids")), strict=True):
            packer.add(doc, start, total, np.frombuffer(ids, "<u4"))
        for last in power_cuts(packer.close(), window // 8):
            packer._send(last)
        yield rows.take()

    names = ["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    left = packed.filter("left_over").withColumn("group", F.floor(F.col("sequence_id") / MERGED_TASKS).cast("long"))
    merged = left.groupBy("group").applyInArrow(second, ", ".join(schema.split(", ")[:7]))
    return packed.filter("not left_over").select(names).unionByName(merged).withColumnRenamed("doc", id_col)


_encoders: dict[str, ByteLevelEncoder] = {}


def _encoder(path: str) -> ByteLevelEncoder:
    """One for each Python worker: what it has learnt serves its next tasks."""
    if path not in _encoders:
        _encoders[path] = ByteLevelEncoder(path)
    return _encoders[path]


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
