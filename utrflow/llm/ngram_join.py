"""N-gram Jaccard self-join with adaptive multi-match prefixes.

All sets are ordered by one global order: light shingles by hash, then those known to be frequent by ascending frequency.
If two sets of which the larger has n shingles are to share t = ceil(3n/4), their prefixes of n - t + l shingles share at
least l. Each document takes the l (from 1 to 24) of least estimated cost: what its longer prefix costs in postings and
pairs, against the candidates (at most the summed frequencies, divided by l) to verify. A pair needs min(l, l') shared
prefix shingles before its whole sets are compared.

Equal sets are one node. Large groups of near copies never become all pairs: two rounds compare each node with one leader
it shares prefix shingles with; then only pairs of nodes that are still in different components are enumerated, where their
sizes and the places of a common shingle allow a link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utrflow.llm.bloom import cells_for, hits, may_repeat, repeated_filter
from utrflow.llm.components import components
from utrflow.llm.segments import END, hashes, joined, lowered, mixed, sized, small_batches
from utrflow.plans.storage import join_sized, release, written

WORDS, MOST_MATCHES = 5, 24
#: Shingles whose frequency is known to the order: at most so many (2 MB); they steer cost only, never the result.
FREQUENT = 1 << 17
BUCKET = 2_000_000
#: Lists of shingles with more nodes than this aren't gathered in a bucket.
LONG_LIST = 200_000
_MIX = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63]


def shingle_sets(texts: list[bytes], seed: int = 0) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles of five words; of all its words, if it has fewer."""
    buf, stops = joined(texts)
    buf = lowered(buf)
    word = ~((buf == 0x20) | ((buf >= 9) & (buf <= 13)) | (buf == END))
    edge = np.diff(word.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    h = hashes(buf, starts, ends)
    edges = np.concatenate([[0], np.searchsorted(starts, stops)])
    with np.errstate(over="ignore"):
        turned = [h * np.uint64(m) for m in _MIX]
        rows = max(0, len(h) - WORDS + 1)
        five = mixed(sum((turned[k][k : k + rows] for k in range(1, WORDS)), turned[0][:rows]) + np.uint64(seed))
        out = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a >= WORDS:
                x = np.sort(five[a : b - WORDS + 1])
                out.append(x[np.append(True, x[1:] != x[:-1])])
            elif b > a:
                out.append(mixed(sum((turned[k][a + k : a + k + 1] for k in range(b - a)), np.full(1, seed + b - a, np.uint64))))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def _signature(tokens: np.ndarray, turn: int) -> int:
    """64 bits that tell the set; the two turns are independent."""
    with np.errstate(over="ignore"):
        total = mixed(tokens * np.uint64(2 * turn + 1) + np.uint64(0xD6E8FEB86659FD93 * (turn + 1) & (2**64 - 1))).sum(dtype=np.uint64)
        return int(mixed(np.array([total + np.uint64(len(tokens))], np.uint64)).astype(np.int64)[0])


def _scan(docs: DataFrame, seed: int, arrow: pa.DataType, kind: str) -> DataFrame:
    """A row for each document (doc, n, node, check), and rows (token, df) of shingles that its task has often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for ids, texts in sized(batches):
            sets = shingle_sets(texts, seed)
            n = pa.array([len(s) for s in sets], pa.int64())
            node = pa.array([_signature(s, 0) for s in sets], pa.int64())
            check = pa.array([_signature(s, 1) for s in sets], pa.int64())
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, arrow), n, node, check, none, none], _NAMES)
            k, c = np.unique(np.concatenate(sets), return_counts=True)
            keys, inverse = np.unique(np.concatenate([keys, k[c > 1]]), return_inverse=True)
            counts = np.bincount(inverse, weights=np.concatenate([counts, c[c > 1]])).astype(np.int64)
            if len(keys) > 2 * FREQUENT:
                top = np.sort(np.argpartition(-counts, FREQUENT)[:FREQUENT])
                keys, counts = keys[top], counts[top]
        own = counts > 3
        none = pa.nulls(int(own.sum()), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.nulls(len(none), arrow), none, none, none, pa.array(keys[own].view(np.int64)), pa.array(counts[own])], _NAMES)

    return docs.mapInArrow(run, f"doc {kind}, n long, node long, check long, token long, df long")


_NAMES = ["doc", "n", "node", "check", "token", "df"]


def prefix(tokens: np.ndarray, frequency: np.ndarray, light: float = 0.05) -> tuple[int, np.ndarray]:
    """The number l of matches that a set asks for, and its prefix; ``frequency`` is 0 where it isn't known."""
    order = np.lexsort((tokens, frequency))
    n = len(tokens)
    t = (3 * n + 3) // 4
    most = min(MOST_MATCHES, t)
    others = np.cumsum(np.where(frequency[order] > 0, np.maximum(frequency[order] - 1, light), light))
    matches = np.arange(1, most + 1)
    size = n - t + matches
    met = others[size - 1]
    best = int(matches[np.argmin(size + met + 0.1 * n * met / matches)])
    return best, tokens[order[: n - t + best]]


def _lists(docs: DataFrame, seed: int, frequent: tuple[np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    """(token, node, n, matches, at) of all prefix shingles that at least two nodes have; ``at`` is the place in the prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = shared.value
        for _, texts in sized(batches):
            nodes, ns, ms, places, found, seen, long_rows = [], [], [], [], [], set(), []
            for s in shingle_sets(texts, seed):
                node = _signature(s, 0)
                if not len(s) or node in seen:
                    continue
                seen.add(node)
                at = np.minimum(np.searchsorted(keys, s), max(0, len(keys) - 1))
                df = np.where(keys[at] == s, counts[at], 0) if len(keys) else np.zeros(len(s), np.int64)
                m, tokens = prefix(s, df)
                place = np.minimum(np.arange(len(tokens)), 0xFFFF).astype("<u2")
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, tokens), len(keys) - 1)
                    hot = (keys[at] == tokens) & (counts[at] > LONG_LIST)
                    long_rows += [(x, node, len(s), m, p) for x, p in zip((tokens[hot] >> np.uint64(1)).astype(np.int64).tolist(), place[hot].tolist(), strict=True)]
                    tokens, place = tokens[~hot], place[~hot]
                nodes.append(node)
                ns.append(len(s))
                ms.append(m)
                places.append(place)
                found.append(tokens)
            if not nodes:
                continue
            tokens, place = np.concatenate(found), np.concatenate(places)
            owner = np.repeat(np.arange(len(nodes)), [len(x) for x in found])
            bucket = ((tokens >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            tokens, place, owner, bucket = tokens[order].astype(np.uint32), place[order], owner[order], bucket[order]
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            nodes, ns, ms = np.array(nodes, np.int64), np.array(ns, np.int64), np.array(ms, np.int64)
            rows = []
            for k in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
                own = owner[edges[k] : edges[k + 1]]
                who, count = np.unique(own, return_counts=True)
                rows.append((k, nodes[who].tobytes(), ns[who].astype("<u4").tobytes(), ms[who].astype(np.uint8).tobytes(), count.astype("<u4").tobytes(), tokens[edges[k] : edges[k + 1]].tobytes(), place[edges[k] : edges[k + 1]].tobytes()))
            kinds = [pa.int64(), *[pa.binary()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] + [pa.nulls(len(rows), pa.int64())] * 5, _POSTED)
            if long_rows:
                yield pa.RecordBatch.from_arrays([pa.nulls(len(long_rows), t) for t in kinds] + [pa.array(c, pa.int64()) for c in zip(*long_rows, strict=True)], _POSTED)

    def meet(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        for b in batches:
            for row in zip(*(b[c].to_pylist() for c in ("nodes", "ns", "ms", "counts", "tokens", "places")), strict=True):
                parts.append([np.frombuffer(x, t) for x, t in zip(row, ("<i8", "<u4", "u1", "<u4", "<u4", "<u2"), strict=True)])
        node, n, m, count, token, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        _, first = np.unique(node, return_index=True)  # equal sets post equal prefixes: once is enough
        new = np.zeros(len(node), bool)
        new[first] = True
        own = np.repeat(new, count)
        token, place, owner = token[own], place[own], np.repeat(np.flatnonzero(new), count[new])
        order = np.argsort(token, kind="stable")
        token, place, owner = token[order], place[order], owner[order]
        same = np.append(False, token[1:] == token[:-1])
        many = same | np.append(same[1:], False)
        token, place, owner = token[many].astype(np.int64) << 16 | key[0].as_py() & 0xFFFF, place[many], owner[many]
        step = 1 << 16
        for a in range(0, len(token), step):
            o = owner[a : a + step]
            yield pa.RecordBatch.from_arrays([pa.array(token[a : a + step]), pa.array(node[o]), pa.array(n[o].astype(np.int64)), pa.array(m[o].astype(np.int64)), pa.array(place[a : a + step].astype(np.int64))], ["token", "node", "n", "matches", "at"])

    posted = written(docs.mapInArrow(post, "bucket long, nodes binary, ns binary, ms binary, counts binary, tokens binary, places binary, token long, node long, n long, matches long, at long"), "postings")
    out = "token long, node long, n long, matches long, at long"
    met = posted.filter("bucket is not null").select(_POSTED[:7]).groupBy("bucket").applyInArrow(meet, out)
    lists = written(met.unionByName(posted.filter("bucket is null").select(_POSTED[7:]).distinct()), "lists")
    release(posted)
    return lists


_POSTED = ["bucket", "nodes", "ns", "ms", "counts", "tokens", "places", "token", "node", "n", "matches", "at"]


def _sets(docs: DataFrame, seed: int, wanted: DataFrame, encode: Callable[[np.ndarray], bytes]) -> DataFrame:
    """(node, tokens) of the documents that stand for the ``wanted`` nodes (node, doc), those with repeated ids several times.

    No text is shuffled.
    """
    total = wanted.count()
    bits = docs.sparkSession.sparkContext.broadcast(repeated_filter(wanted.select(F.xxhash64("doc").alias("h")), "h", total, least=1))
    cells = cells_for(total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = np.frombuffer(bits.value, np.uint8), set()
        for batch in batches:
            batch = batch.filter(pa.array(hits(table, batch["h"].to_numpy(), cells)))
            for _, texts in sized([batch.select(["h", "text"])]):
                found = [(node, encode(s)) for s in shingle_sets(texts, seed) if len(s) and (node := _signature(s, 0)) not in seen]
                seen.update(node for node, _ in found)
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], ["node", "tokens"])

    return docs.select(F.xxhash64("doc").alias("h"), "text").mapInArrow(run, "node long, tokens binary")


def _six(tokens: np.ndarray) -> bytes:
    """The upper six bytes of each sorted hash: within a pair of documents that suffices to tell shingles apart."""
    return tokens.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _common(x: bytes, y: bytes) -> tuple[int, int, int]:
    """The sizes of two sets that ``_six`` wrote, and what they share."""
    p, q = (np.frombuffer(z, np.uint8).reshape(-1, 6) for z in (x, y))
    wide = np.zeros((len(p) + len(q), 8), np.uint8)
    wide[: len(p), :6], wide[len(p) :, :6] = p, q
    both = wide.view(">u8").ravel().astype(np.uint64)
    both.sort(kind="stable")
    return len(p), len(q), int((both[1:] == both[:-1]).sum())


def _brief(tokens: np.ndarray) -> bytes:
    """About a byte a shingle: the sorted hashes' upper bits, 32 to 64 times as many values as shingles, as steps (255 adds 255 to the next)."""
    steps = np.diff((tokens >> np.uint64(64 - _bits(len(tokens)))).astype(np.int64), prepend=0)
    ends = np.cumsum(steps // 255 + 1)
    out = np.full(int(ends[-1]), 255, np.uint8)
    out[ends - 1] = steps % 255
    return out.tobytes()


def _bits(n: int) -> int:
    return (n - 1).bit_length() + 5


def _at_most(x: bytes, y: bytes) -> tuple[int, int, int]:
    """The sizes of two sets that ``_brief`` wrote, and a bound of what they share: equal values count as shared."""
    places = []
    for z in (x, y):
        step = np.frombuffer(z, np.uint8)
        places.append(np.cumsum(step, dtype=np.int64)[step != 255])
    sizes = [len(p) for p in places]
    for k, p in enumerate(places):
        p >>= _bits(sizes[k]) - _bits(min(sizes))
        first = np.append(True, p[1:] != p[:-1])
        at = np.arange(len(p))
        places[k] = p << 24 | at - np.maximum.accumulate(np.where(first, at, 0))  # the first of equal values meets the other's first
    both = np.concatenate(places)
    both.sort(kind="stable")
    return *sizes, int((both[1:] == both[:-1]).sum())


def _likely(pairs: DataFrame, sets: DataFrame, common: Callable[[bytes, bytes], tuple[int, int, int]]) -> DataFrame:
    """The ``pairs`` (a, b) of nodes for which 100 * common >= 75 * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                p, q, both = common(x.as_py(), y.as_py())
                keep.append(100 * both >= 75 * (p + q - both))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, seed: int, repeat: bool) -> DataFrame:
    """The ``pairs`` (a, b) of nodes that link: whole sets are fetched only for pairs that a bound of what they share leaves."""
    for encode, common in ((_brief, _at_most), (_six, _common)):
        wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "doc"), "node"), "wanted")
        sets = written(_sets(docs, seed, wanted, encode), "sets")
        left = written(_likely(pairs, sets.dropDuplicates(["node"]) if repeat else sets, common), "links")
        release(wanted, sets, pairs)
        pairs = left
    return pairs


#: What the sets of a linked pair share at least, and, following from it, where their first common shingle stands at most.
SHARED = "(3 * (n + other_n) + 6) div 7"
FIRST = f"at <= n - {SHARED} and other_at <= other_n - {SHARED}"


def _live(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """The lists with each node's component (``comp``), of shingles that still join several components. ``lists`` goes."""
    own = written(lists.drop("comp").join(roots.withColumnRenamed("root", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node")), "lists")
    release(lists)
    ends = own.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("token")
    live = written(own.join(ends, "token", "left_semi"), "live")
    release(own)
    return live


def _to_leaders(live: DataFrame, seed: int) -> DataFrame:
    """For each node the pair with that leader, of those its shingles have, with which it shares most of them.

    The leader of a shingle is the node in whose prefix it stands first: one with few shingles of its own.
    """
    leaders = live.groupBy("token").agg(F.min(F.struct("at", F.xxhash64("node", F.lit(seed)).alias("h"), "node", "n", "comp")).alias("l")).select("token", *[F.col(f"l.{c}").alias(f"other_{c}") for c in ("at", "node", "n", "comp")])
    met = live.join(leaders, "token").filter("comp != other_comp").filter(FIRST).groupBy("node", "other_node").agg(F.count(F.lit(1)).alias("count"))
    best = met.groupBy("node").agg(F.max(F.struct("count", "other_node")).alias("best"))
    return best.select(F.least("node", "best.other_node").alias("a"), F.greatest("node", "best.other_node").alias("b")).distinct()


#: Whether one of the two shingles before a common one (in either's prefix) is common, too: the pair is met there.
BEFORE = "coalesce(p1 = other_p1, false) or coalesce(p1 = other_p2, false) or coalesce(p2 = other_p1, false) or coalesce(p2 = other_p2, false)"


def _others(live: DataFrame) -> DataFrame:
    """All pairs of nodes in different components that share as many prefix shingles as they must."""
    own = live.groupBy("node", "comp", "n", "matches").agg(F.array_sort(F.collect_list(F.struct("at", "token"))).alias("found"))
    own = written(own.select("node", "comp", "n", "matches", F.col("found.token").alias("tokens"), F.col("found.at").alias("places")), "prefixes")
    rows = own.select("node", "comp", "n", "tokens", "places", F.posexplode("tokens").alias("i", "token"))
    before = lambda k: F.get("tokens", F.col("i") - k).alias(f"p{k}")
    rows = rows.select("token", "node", "comp", "n", F.get("places", F.col("i")).alias("at"), before(1), before(2))
    main = live.groupBy("token", "comp").count().groupBy("token").agg(F.max(F.struct("count", "comp")).alias("m")).select("token", F.col("m.comp").alias("main"))
    rows = rows.join(main, "token")
    minor = rows.filter("comp != main").select("token", *[F.col(c).alias(f"other_{c}") for c in ("node", "comp", "n", "at", "p1", "p2")])
    # of two minor nodes the pair is made once
    met = rows.join(minor, "token").filter(f"comp != other_comp and (comp = main or node < other_node) and {FIRST} and not ({BEFORE})")
    pairs = written(met.select(F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b")).distinct(), "met")
    # the count of shared prefix shingles: places and 16 bits of each shingle, so that it may be too high, never too low
    brief = F.zip_with("places", "tokens", lambda p, t: F.least(p, F.lit(0x7FFF)).cast("int") * 0x10000 + F.pmod(F.hash(t), F.lit(0x10000)))
    prefixes = own.select("node", "n", "matches", brief.alias("found"))
    both = pairs.join(prefixes.withColumnRenamed("node", "a"), "a").join(prefixes.select(F.col("node").alias("b"), *[F.col(c).alias(f"other_{c}") for c in ("n", "matches", "found")]), "b")
    both = both.withColumn("need", F.least("matches", "other_matches"))
    for side in ("", "other_"):
        upto = f"{side}n - {SHARED} + need"
        both = both.withColumn(f"{side}short", F.expr(f"transform(filter({side}found, x -> x div 65536 < {upto}), x -> x % 65536)"))
    enough = "size(array_intersect(short, other_short)) + size(short) - size(array_distinct(short)) >= need"
    asked = written(both.filter(enough).select("a", "b"), "pairs")
    release(own, pairs)
    return asked


def jaccard_components(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each row of ``df``: its id, n_shingles, component_id (the smallest id reachable by links).

    Two texts link when they share at least 75 of 100 of all their distinct shingles of five words. Null, empty and blank
    texts have no shingles and link with nothing, not even with each other; their component is their own id. Equal sets
    link. Null ids are passed over as component ids; a component of only such has null. Rows may repeat. Other columns are
    not read. An empty table gives no rows.
    """
    kind = df.schema[id_col].dataType.simpleString()
    small_batches(df.sparkSession)
    docs = df.select(F.col(id_col).alias("doc"), F.col(text).alias("text"))
    arrow = docs.select("doc").limit(0).toArrow().schema.field(0).type
    for seed in range(8):
        scan = written(_scan(docs, seed, arrow, kind), "scan")
        rows = scan.filter("n is not null").select("doc", "n", "node", "check")
        nodes = written(rows.filter("n > 0").groupBy("node").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"), F.min("check").alias("lo"), F.max("check").alias("hi")), "nodes")
        if nodes.filter("lo != hi").isEmpty():  # else two different sets share 64 bits: hash anew
            break
    many, shingles = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("total"), F.lit(0))).first()
    known = scan.filter("token is not null").groupBy("token").agg(F.sum("df").alias("df")).orderBy(F.desc("df"), "token").limit(FREQUENT).toArrow()
    keys, counts = known["token"].to_numpy().view(np.uint64), known["df"].to_numpy()
    order = np.argsort(keys)
    repeat = not rows.groupBy("doc").count().filter("count > 1").isEmpty()
    lists, roots = _lists(docs, seed, (keys[order], counts[order]), max(1, shingles * 3 // 10 // BUCKET)), None
    for step in range(3):
        if roots is not None:
            lists = _live(lists, roots)
        live = lists.withColumn("comp", F.col("node")) if roots is None else lists
        pairs = _others(live) if step == 2 else written(_to_leaders(live, step), "pairs")
        if step and pairs.isEmpty():
            continue
        links = _linked(pairs, docs, nodes, seed, repeat)
        # what was joined before stays joined: each node with its root
        found = components(links if roots is None else links.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        release(links, roots)
        roots = found
    release(lists)
    joined_nodes = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = joined_nodes.groupBy("root").agg(F.min("doc").alias("component"), F.sum("size").alias("members"), F.count(F.lit(1)).alias("sets"))
    total = rows.count()
    # rows alone in their component need no join
    answers = join_sized(joined_nodes.select("node", "root", "size"), least.filter("members > 1"), "root", "sets", max(1, many)).filter("component is not null").select("node", "size", "component")
    found = join_sized(rows.filter("n > 0"), answers, "node", "size", total)
    none = rows.filter("n = 0").withColumns({"size": F.lit(1).cast("long"), "component": F.col("doc")})
    return found.unionByName(none).select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))


def keep_first(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``df`` with one document of each component: that with the smallest id, all columns as they were.

    Only rows whose id may be among those that go are shuffled. Rows with a null id stay; an id that repeats goes or stays
    with all its rows.
    """
    found = jaccard_components(df, text, id_col)
    gone = written(found.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__gone")).distinct(), "gone")
    total = gone.count()
    bits = repeated_filter(gone.select(F.xxhash64("__gone").alias("h")), "h", total, least=1)
    own = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__doc")
    tested = df.select(own).withColumn("__gone", F.col(f"__doc.`{id_col}`")).withColumn("__h", F.xxhash64("__gone"))
    tested = tested.withColumn("__may", may_repeat(df.sparkSession, bits, total, "__h"))
    kept = tested.filter("__may").join(gone, "__gone", "left_anti")
    return tested.filter("not __may").select("__doc.*").unionByName(kept.select("__doc.*"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
k AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS o FROM documents UNION SELECT r.doc_id, k.b FROM r JOIN k ON k.a = r.o)
SELECT s.doc_id, len(any_value(s.s)) AS n_shingles, min(r.o) AS component_id FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id
"""
