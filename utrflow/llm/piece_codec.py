"""SentencePiece encoding and decoding of merge-type vocabularies.

Texts are cut into segments that no piece crosses (before a run of spaces, and around characters that no longer piece has);
each distinct segment is encoded once by a score-ordered agenda of adjacent symbol pairs, and checked against the
sentencepiece library, as is a whole text of every portion. Decoding turns the ids back into pieces and bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utrflow.llm.agenda import Merges
from utrflow.llm.segments import IdCache, joined, ragged, sized, small_batches

MARK = "▁".encode()
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message."""
    i = 0

    def number() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value

    while i < len(data):
        field, kind = divmod(number(), 8)
        if kind == 0:
            yield field, number()
        else:
            n = {1: 8, 5: 4}.get(kind) or number()
            yield field, data[i : i + n]
            i += n


class PieceCodec:
    """A merge-type model file: identity normalisation, a space before each text, byte fallback. Others are refused."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, scores, kinds = [], [], []
        trainer: dict = {}
        norm: dict = {}
        with open(path, "rb") as f:
            for field, value in _fields(f.read()):
                if field == 1:
                    p = dict(_fields(value))
                    pieces.append(p.get(1, b""))
                    scores.append(np.frombuffer(p.get(2, bytes(4)), "<f4")[0])
                    kinds.append(p.get(3, NORMAL))
                elif field == 2:
                    trainer = dict(_fields(value))
                elif field == 3:
                    norm = dict(_fields(value))
        if trainer.get(3) != 2 or not trainer.get(35) or norm.get(2) or norm.get(3, 1) != 1 or norm.get(4, 1) or {USER, UNUSED} & set(kinds):
            raise ValueError(f"{path}: only merge-type models with byte fallback, a dummy prefix and no normalisation")
        #: Symbols: the pieces, then single characters that occur in pieces only.
        symbols = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == NORMAL}
        self.fallback = np.array([pieces.index(b"<0x%02X>" % b) for b in range(256)])
        n = len(pieces)
        for p in [p for p, k in zip(pieces, kinds, strict=True) if k == NORMAL]:
            for c in p.decode():
                symbols.setdefault(c.encode(), len(symbols) + n)
        self.extra = {i: s for s, i in symbols.items() if i >= n}
        rows = []
        for p, i in list(symbols.items()):
            if i < n:
                text = p.decode()
                for k in range(1, len(text)):
                    a, b = symbols.get(text[:k].encode()), symbols.get(text[k:].encode())
                    if a is not None and b is not None:
                        rows.append((a, b, i))
        left, right, result = (np.array(x) for x in zip(*rows, strict=True))
        order = np.argsort(-np.array(scores), kind="stable")
        rank = np.unique(-np.array(scores)[order], return_inverse=True)[1][np.argsort(order)]
        self.merges = Merges(left, right, rank[result], result)
        self.single = {s.decode(): i for s, i in symbols.items() if len(s.decode()) == 1}
        long = {c for p, k in zip(pieces, kinds, strict=True) if k == NORMAL and len(p.decode()) > 1 for c in p.decode()}
        if any("▁" in p.decode().lstrip("▁") for p, k in zip(pieces, kinds, strict=True) if k == NORMAL):
            raise ValueError(f"{path}: a piece has a space after other characters")
        self.alone = np.array([b < 0x80 and chr(b) not in long and b != 0x20 for b in range(256)])
        #: What each id decodes to.
        self.bytes = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, b" ") for p, k in zip(pieces, kinds, strict=True)]
        self.is_byte = np.array([k == BYTE for k in kinds])
        self.decimal, self.decimal_at, self.decimal_len = self._table([b"%d," % i for i in range(n)])
        self.out, self.out_at, self.out_len = self._table(self.bytes)
        self.cache = IdCache(self._ids)
        self.unequal = 0

    @staticmethod
    def _table(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        return np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths, lengths

    def _segment_symbols(self, text: str) -> list[int]:
        """A character without a symbol of its own gets -1 - its code point: nothing merges with it."""
        return [self.single.get(c, -1 - ord(c)) for c in text]

    def _ids(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [s.decode().replace(" ", "▁") for s in segments]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        chars, inverse = np.unique(points, return_inverse=True)
        symbols = np.array(self._segment_symbols("".join(map(chr, chars.tolist()))), np.int64)[inverse] if len(points) else np.empty(0, np.int64)
        # Merges' keys need symbols from 0: those that never merge share one that no pair has
        idle = len(self.single) + len(self.bytes) + 1
        lone = symbols < 0
        got, lengths = self.merges.run(np.where(lone, idle + np.cumsum(lone), symbols), np.fromiter(map(len, texts), np.int64, len(texts)))
        odd = np.flatnonzero(got >= len(self.bytes))
        if odd.size:
            whole = symbols[lone]
            parts, n = [], np.ones(len(got), np.int64)
            for k in odd.tolist():
                s = int(got[k])
                raw = self.extra[s] if s in self.extra else chr(-1 - int(whole[s - idle - 1])).encode()
                parts.append(self.fallback[np.frombuffer(raw, np.uint8)])
                n[k] = len(raw)
            owner = np.repeat(np.arange(len(lengths)), lengths)
            lengths = np.bincount(owner, weights=n, minlength=len(lengths)).astype(np.int64)
            at = np.cumsum(n) - n
            out = np.empty(int(n.sum()), np.int64)
            plain = np.ones(len(got), bool)
            plain[odd] = False
            out[at[plain]] = got[plain]
            out[np.concatenate([np.arange(at[k], at[k] + n[k]) for k in odd.tolist()])] = np.concatenate(parts)
            got = out
        return self._checked(segments, got, lengths)

    def _checked(self, segments: list[bytes], got: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The agenda's ids, compared with the library's; of a segment where they differ the library's stand, and ``unequal`` counts it."""
        lead = [s[:1] == b" " for s in segments]
        asked = self.library.encode([s[1:].decode() if own else "\n" + s.decode() for s, own in zip(segments, lead, strict=True)], num_threads=1)
        # a lone space is the prefix of an empty text, for which the library gives nothing
        asked = [(x if own else x[2:]) if s != b" " else self.library.encode("\n", num_threads=1)[:1] for s, own, x in zip(segments, lead, asked, strict=True)]
        return self._settled(got, lengths, asked)

    def _settled(self, got: np.ndarray, lengths: np.ndarray, asked: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """``got``, but for the runs of ids that aren't those ``asked`` for."""
        n = np.fromiter(map(len, asked), np.int64, len(asked))
        if np.array_equal(n, lengths) and np.array_equal(np.fromiter((i for x in asked for i in x), np.int64, int(n.sum())), got):
            return got, lengths
        mine = np.split(got, np.cumsum(lengths)[:-1])
        wrong = [x.tolist() != y for x, y in zip(mine, asked, strict=True)]
        self.unequal += sum(wrong)
        mine = [np.array(y, np.int64) if bad else x for bad, x, y in zip(wrong, mine, asked, strict=True)]
        return np.concatenate(mine), np.fromiter(map(len, mine), np.int64, len(mine))

    def segments(self, buf: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = np.zeros(len(buf), bool)
        space = buf == 0x20
        start[1:] = space[1:] & ~space[:-1]
        alone = self.alone[buf]
        start |= alone
        start[1:] |= alone[:-1]
        start[0] = True
        start[stops] = True
        start[stops[:-1] + 1] = True
        at = np.flatnonzero(start)
        end = np.append(at[1:], len(buf))
        real = buf[at] != 0xFF
        return at[real], end[real]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The joined ids of the texts, and the number of each text's."""
        texts = [t.replace(MARK, b" ") for t in texts]
        full = [b" " + t if t else t for t in texts]
        buf, stops = joined(full)
        starts, ends = self.segments(buf, stops)
        if not len(starts):
            return np.empty(0, np.int64), np.zeros(len(texts), np.int64)
        inverse, at, ln = self.cache.lookup(buf, starts, ends)
        lengths = ln[inverse]
        ids = self.cache.flat[ragged(at[inverse], lengths)].astype(np.int64)
        edges = np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(starts, stops)]
        counts = np.diff(edges, prepend=0)
        one = int(np.argmin(np.where(counts > 0, counts, NEVER)))
        theirs = self.library.encode(texts[one].decode(), num_threads=1)
        if ids[edges[one] - counts[one] : edges[one]].tolist() != theirs:  # then all texts of the portion are compared
            return self._settled(ids, counts, self.library.encode([t.decode() for t in texts], num_threads=1))
        return ids, counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The UTF-8 text of each run of ids. Bytes that don't form a character are left to the library's rules."""
        lengths = self.out_len[ids]
        data = self.out[ragged(self.out_at[ids], lengths)].tobytes()
        edges = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum(counts)
        out = []
        for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
            text = data[edges[a] : edges[b]]
            text = text[1:] if b > a and text[:1] == b" " and not self.is_byte[ids[a]] else text
            try:
                text.decode()
            except UnicodeDecodeError:
                text = self.library.decode(ids[a:b].tolist()).encode()
            out.append(text)
        return out

    def id_lists(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Each run of ids in decimal, joined by commas."""
        lengths = self.decimal_len[ids]
        data = self.decimal[ragged(self.decimal_at[ids], lengths)].tobytes()
        edges = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum(counts)
        return [data[edges[a] : max(edges[a], edges[b] - 1)] for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]


NEVER = np.iinfo(np.int64).max
_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One for each Python worker."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def encode_texts(df: DataFrame, model: str, text: str = "text", id_col: str = "doc_id", digests: bool = False) -> DataFrame:
    """The id and ``ids`` (array) and ``decoded`` (the text they give) of each row; null texts count as empty (no ids).

    With ``digests``: n_tokens, ids_sha256 and decoded_sha256 in place of those. ``unequal`` counts the row's portion's
    segments in which the agenda differed from the library (whose ids then stand for that segment): 0 unless one of the two is at fault.
    Ids may be null or repeat; other columns are not read; an empty table gives no rows.
    """
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    arrow = df.select(F.col(id_col).alias("doc")).limit(0).toArrow().schema.field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for docs, texts in sized(batches):
            before = c.unequal
            ids, counts = c.encode(texts)
            decoded, docs = c.decode(ids, counts), pa.array(docs, arrow)
            unequal = pa.array([c.unequal - before] * len(docs), pa.int64())
            if digests:
                hashed = [[hashlib.sha256(x).hexdigest() for x in xs] for xs in (c.id_lists(ids, counts), decoded)]
                yield pa.RecordBatch.from_arrays([docs, pa.array(counts, pa.int64()), pa.array(hashed[0], pa.string()), pa.array(hashed[1], pa.string()), unequal], ["doc", "n_tokens", "ids_sha256", "decoded_sha256", "unequal"])
            else:
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([docs, lists, pa.array(decoded, pa.binary()).cast(pa.string()), unequal], ["doc", "ids", "decoded", "unequal"])

    schema = f"doc {kind}, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string") + ", unequal long"
    return df.select(F.col(id_col).alias("doc"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("doc", id_col)


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"), digests=True)
