"""Byte segments of many texts at once: hashes, and ids that are worked out once for each distinct segment."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

import numpy as np

#: Ends each text in a joined buffer; the byte never occurs in UTF-8.
END = 0xFF
_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD1342543DE82EF95 | 1 if (0xD1342543DE82EF95 >> 1) & 1 else 0xD1342543DE82EF97
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i to n."""
    if len(_POWERS[0]) <= n:
        size = 1 << n.bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[k] = np.cumprod(x, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, piece: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each buf[start:end]; starts ascend, segments don't overlap."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        base = int(starts[a])
        b = max(a + 1, int(np.searchsorted(ends, base + piece, "right")))
        s, e = starts[a:b] - base, ends[a:b] - base
        up, down = _powers(n := int(e[-1]))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[buf[base : base + n]] * up[:n], out=sums[1:])
        out[a:b] = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        a = b
    return out


def ragged(offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices offset, offset + 1, ... offset + length - 1 of each row, one after another."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(offsets - before, lengths) + np.arange(int(lengths.sum()))


def joined(texts: list[bytes], prefix: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """The texts in one buffer, each with END after it, and where each END is."""
    tail = bytes([END])
    buf = np.frombuffer(tail.join([prefix + t for t in texts]) + tail, np.uint8)
    lengths = np.fromiter((len(t) + len(prefix) + 1 for t in texts), np.int64, len(texts))
    return buf, np.cumsum(lengths) - 1


class IdCache:
    """Ids of distinct segments by hash, in flat arrays (``encode`` gives the joined ids and their numbers). It forgets all when it holds ``most`` segments (then it asks again)."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = 600_000):
        self.encode, self.most = encode, most
        self._empty()

    def _empty(self) -> None:
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.tables = [[np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)] for _ in range(2)]  # settled, recent

    def _add(self, keys: np.ndarray, new: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used : self.used + len(new)] = new
        rows = [keys, self.used + np.cumsum(lengths) - lengths, lengths]
        self.used += len(new)
        settled, recent = self.tables
        recent = [np.concatenate(x) for x in zip(recent, rows, strict=True)]
        if len(recent[0]) > 50_000 + len(settled[0]) // 4:
            settled, recent = [np.concatenate(x) for x in zip(settled, recent, strict=True)], [x[:0] for x in recent]
            order = np.argsort(settled[0], kind="stable")
            settled = [x[order] for x in settled]
        order = np.argsort(recent[0], kind="stable")
        self.tables = [settled, [x[order] for x in recent]]

    def lookup(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each segment the index of its distinct segment; of the distinct segments, offset and length in ``flat``."""
        keys, first, inverse = np.unique(hashes(buf, starts, ends), return_index=True, return_inverse=True)
        if len(self.tables[0][0]) + len(self.tables[1][0]) + len(keys) > self.most:
            self._empty()
        at, ln = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)

        def fill() -> None:
            for table in self.tables:
                if len(table[0]):
                    i = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
                    hit = table[0][i] == keys
                    at[hit], ln[hit] = table[1][i[hit]], table[2][i[hit]]

        fill()
        if (new := np.flatnonzero(at < 0)).size:
            data = buf.tobytes() if new.size > 1000 else buf
            s, e = starts[first[new]].tolist(), ends[first[new]].tolist()
            self._add(keys[new], *self.encode([bytes(data[a:b]) for a, b in zip(s, e, strict=True)]))
            fill()
        return inverse, at, ln


def lowered(buf: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z."""
    return buf + ((buf >= 65) & (buf <= 90)).astype(np.uint8) * np.uint8(32)


def small_batches(spark) -> None:
    """From now on the session's Arrow batches hold 4 MB, so that long texts don't make them large."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def give_back() -> None:
    """Returns what this Python worker has freed to the system: workers live on from task to task and from stage to stage."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def sized(batches, size: int = 1 << 20):
    """The first column's values and the second's texts as bytes (null as empty), in portions of about ``size`` bytes."""
    import pyarrow as pa

    for b in batches:
        docs, texts, used = [], [], 0
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
            docs.append(doc)
            texts.append(text.as_py() or b"")
            used += len(texts[-1])
            if used >= size:
                yield docs, texts
                docs, texts, used = [], [], 0
        if docs:
            yield docs, texts
    give_back()
