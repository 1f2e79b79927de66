"""Quality, periodic runs and spelling variants against brute force, held-out labels, and odd rows."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from utrflow.llm import periodic, quality, queries, spelling

ODD = [None, "", " ", "\n\t", "a", "a b a b a b a b a b a b", "x " * 5000, "é" * 50, "x" * 50_000, "x" * 49_999, "the end. " * 3000, "日本 😀 ﬁ", "Aa aA aa AA " * 4]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i != 4 else None, t, "kept", i) for i, t in enumerate(ODD)] + [(6, ODD[6], "again", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, runs string, n int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, x binary")


# --- quality


def area(scores, labels):
    order = np.argsort(scores, kind="stable")
    _, inverse, n = np.unique(np.asarray(scores)[order], return_inverse=True, return_counts=True)
    ranks = np.empty(len(order))
    ranks[order] = (np.cumsum(n) - (n - 1) / 2)[inverse]
    good = np.asarray(labels) == 1
    return (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_quality_on_held_out_labels(spark):
    rows = queries.QUERIES["op11_quality"](spark, "/root/testdata/sf0.01").toPandas()
    assert len(rows) == 1000 and rows["score"].between(0, 1).all()
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == h for i, h in zip(rows["doc_id"], rows["held_out"], strict=True))
    assert ((rows["score"] >= 0.3) == (rows["predicted"] == 1)).all()
    both = rows.merge(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas(), on="doc_id")
    held = both[both["held_out"]]
    assert area(held["score"].to_numpy(), held["quality"].to_numpy()) > 0.97
    assert held[held["quality"] == 1]["predicted"].mean() > 0.95 and held[held["quality"] == 0]["predicted"].mean() < 0.2


def test_quality_learns_nothing_from_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    rows = quality.measured(docs)
    a, b = (quality.fit(rows, x) for x in (labels, turned))
    assert np.allclose(a.good.mean, b.good.mean) and np.allclose(a.bad.factor, b.bad.factor)


def test_quality_sums_equal_numpy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    model = quality.fit(quality.measured(docs.repartition(5)), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    rows = docs.select("doc_id", "text").toPandas()
    counts = quality.counts([(t or "").encode() for t in rows["text"]]).astype(float)
    known = [i for i, d in enumerate(rows["doc_id"]) if d in labels and zlib.crc32(str(d).encode()) % 5]
    x, y = quality.statistics(counts[known], counts.sum(axis=0)), np.array([labels[rows["doc_id"][i]] for i in known])
    assert np.allclose(model.centre, x.mean(axis=0)) and np.allclose(model.scale, x.std(axis=0))
    good = (x[y == 1] - x.mean(axis=0)) / x.std(axis=0)
    want = quality.shrunk(np.cov(good.T, bias=True), len(good))
    assert np.allclose(model.good.factor @ model.good.factor.T, want)
    z = good[:5] - good.mean(axis=0)
    distance = np.einsum("ij,jk,ik->i", z, np.linalg.inv(want), z)
    assert np.allclose(model.good.log_density(good[:5]), np.log((y == 1).mean()) - 0.5 * (distance + np.linalg.slogdet(want)[1]))


def test_quality_counts():
    own = dict(zip((*("words", "bytes", "squares"), *quality.OF_WORDS, *quality.OF_BYTES), quality.counts([b"The cat, the 12 |\nthe the.", b""])[0].tolist(), strict=True))
    assert own == {"words": 7, "bytes": 20, "squares": 9 + 16 + 9 + 4 + 1 + 9 + 16, "without a letter": 2, "ending a clause": 2, "as the one before": 0, "as the second before": 1, "first occurrences": 5, "as the most frequent": 3, "up to 3 bytes": 5, "12 bytes or more": 0, "beginning in upper case": 1, "line ends": 1, "symbols": 1, "digits": 2, "beyond ASCII": 0}
    assert not quality.counts([b"", b" \n"])[0].any()


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1), (3, None), (3, 1), (3, 1)], "doc_id long, quality int")
    rows = quality.measured(odd)
    got = quality.score(rows, quality.fit(rows, labels)).collect()
    assert len(got) == len(ODD) + 1 and all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["doc_id"] is None and not r["held_out"] for r in got) == 1
    nothing = quality.measured(empty)
    assert quality.fit(nothing, labels) is None and quality.score(nothing, None).count() == 0
    assert {r["score"] for r in quality.score(rows, quality.fit(rows, labels.limit(0))).collect()} == {0.5}
    assert quality.fit(rows, labels.filter("quality = 1")) is None


# --- periodic runs


def brute_runs(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(i + 1, j)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def repetitive(r, words):
    out = []
    while len(out) < words:
        out += [r.choice("ab" if r.random() < 0.5 else "abcdefgh") for _ in range(r.randint(1, 7))] * r.choice([1, 1, 2, 3, 6])
    return out


def test_runs_equal_brute_force():
    r = random.Random(3)
    for trial in range(150):
        texts = [" ".join(repetitive(r, r.choice([1, 5, 30, 90]))).encode() for _ in range(6)]
        least = r.choice([1, 2, 3, 4, 12]) if trial % 2 else 12
        n, rows = periodic.runs_of(texts, least, block=r.choice([3, 50, 1 << 20]))
        for t, text in enumerate(texts):
            assert [tuple(x[1:]) for x in rows.tolist() if x[0] == t] == brute_runs(text.split(), least) and n[t] == len(text.split())


def test_misleading_hashes_are_found_out(monkeypatch):
    """With hashes that tell words apart by their length only, comparing the words mends the runs."""
    monkeypatch.setattr(periodic, "hashes", lambda buf, starts, ends: (ends - starts).astype(np.uint64))
    r = random.Random(5)
    texts = [" ".join(r.choice(["a", "b", "cc", "dd"]) for _ in range(60)).encode(), ("a bb " * 20).encode(), b"", ("a b c " * 9).encode()]
    _, rows = periodic.runs_of(texts)
    for t, text in enumerate(texts):
        assert [tuple(x[1:]) for x in rows.tolist() if x[0] == t] == brute_runs(text.split())


def test_prefixes_of_a_sequence_that_defeats_wrapping_hashes():
    bits = [0]
    for _ in range(12):
        bits += [1 - b for b in bits]
    _, rows = periodic.runs_of([" ".join("ab"[b] for b in bits).encode()])
    assert all(x[2] < 3 * x[3] for x in rows.tolist())  # it holds squares, but nothing three times in a row


def brute_periodic(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and words and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    s, n, q = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    collapsed = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), s, n, q, None if s is None else 1000 * n // q, sha("".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda x: (x[0], x[2])))), sha(collapsed))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_periodic_query_equals_brute_force(spark, tmp_path):
    r = random.Random(8)
    own = [(i, r.choice([" ", "  ", "\n"]).join(repetitive(r, r.choice([1, 20, 150])))) for i in range(150)]
    real = [(x["doc_id"], x["text"]) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if len(x["text"] or "") < 5000]
    rows = own + [(1000 + i, t) for i, t in real] + [(None, "a b " * 9), (7000, None), (7001, ""), (7001, " \t"), (7002, "   x " * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op12_periodic"](spark, str(tmp_path)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[7])
    assert sorted((tuple(x[c] for c in COLUMNS) for x in got), key=key) == sorted((brute_periodic(*x) for x in rows), key=key)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None) > 20


def test_periodic_odd_rows(odd, empty):
    rows = periodic.find_runs(odd).collect()
    assert len(rows) == len(ODD) + 1 and all(r["runs"] is not None and r["collapsed"] is not None for r in rows)
    of = {r["doc_id"]: r for r in rows}
    assert of[5]["runs"] == [(0, 12, 2)] and of[5]["collapsed"] == "a b"
    assert of[6]["runs"] == [(0, 5000, 1)] and of[6]["collapsed"] == "x" and of[0]["collapsed"] == ""
    assert of[12]["runs"] == [(0, 16, 4)] and of[11]["n_words"] == 3
    assert periodic.find_runs(empty).count() == 0


# --- spelling variants


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute_near(words):
    return {(min(a, b), max(a, b)) for i, a in enumerate(words) for b in words[i + 1 :] if near(a, b)}


def vocabulary(r, n):
    base = ["".join(r.choice("abé") for _ in range(r.randint(2, 9))) for _ in range(n)] + ["aaaaaaa" + "".join(r.choice("abc") for _ in range(3)) for _ in range(n)]
    return sorted(set(base))


@pytest.mark.parametrize("rows", [20, 60, 100_000])
def test_near_pairs_equal_brute_force(spark, rows):
    """With few rows to a trie, halves that many words share go by the exact joins."""
    words = vocabulary(random.Random(rows), 120)
    # so few words that a thousandth of all never exceeds the limit
    got = spelling.near_pairs(spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long").repartition(3), rows).collect()
    pairs = [(min(r["word"], r["near"]), max(r["word"], r["near"])) for r in got]
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute_near(words)
    assert all(words[r["n"]] == r["word"] and words[r["near_n"]] == r["near"] for r in got)


def test_trie_finds_each_pair_of_a_group_once():
    words = sorted({"".join(x) for x in (random.Random(i).choices("ab", k=random.Random(i).randint(0, 6)) for i in range(300))})
    groups = np.zeros(len(words), np.int64)
    got = [(x, y) for a, b, _ in spelling.near_rows(groups, words) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert len(got) == len(set(got)) and {(min(words[x], words[y]), max(words[x], words[y])) for x, y in got} == brute_near(words)


def brute_variants(rows, least=2, shortest=7):
    n = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] = n.get(word, 0) + 1
    n = {w: k for w, k in n.items() if k >= least and len(w) >= shortest}
    others, out = {w: [] for w in n}, {}
    for a, b in brute_near(sorted(n)):
        others[a].append(b)
        others[b].append(a)
    form = {}
    for w, k in n.items():
        best = min(others[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * k else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(others[w]), n.get(form[w]))
    return out


def test_spelling_query_equals_brute_force(spark, tmp_path):
    r = random.Random(2)
    chain = [("kilogram " * 2 + "kilograms " * 30 + "kilogrames " * 450 + "Kilogramees " * 7000)]
    own = [(i, " ".join(r.choice(["thousand", "Thousand", "thousands", "Éclairs", "éclairs", "abcdefg×÷", "short", "x1thousand"]) for _ in range(60))) for i in range(60)]
    real = [(x["doc_id"], x["text"]) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if len(x["text"] or "") < 4000][:100]
    rows = own + [(100 + i, t) for i, t in enumerate(chain * 9)] + [(1000 + i, t) for i, t in real] + [(None, "nothing nothing"), (1, None), (2, ""), (2, "repeated repeated")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_spelling"](spark, str(tmp_path)).collect()
    assert {x["word"]: (x["form"], x["root"], x["n"], x["n_near"], x["form_n"]) for x in got} == brute_variants(rows) and len(got) == len({x["word"] for x in got})
    assert any(x["form"] and x["root"] != x["form"] for x in got)


def test_spelling_odd_rows(odd, empty):
    words = {r["word"]: r["n"] for r in spelling.occurrences(odd).collect()}
    assert words == {"x" * 50_000: 1, "x" * 49_999: 1, "é" * 50: 1}
    got = spelling.group_variants(spelling.occurrences(odd)).collect()
    assert {len(r["word"]): r["n_near"] for r in got} == {50_000: 1, 49_999: 1, 50: 0} and all(r["form"] is None and r["root"] == r["word"] for r in got)
    assert spelling.group_variants(spelling.occurrences(empty)).count() == 0


def test_spelling_ties_go_to_the_first_word(spark):
    words = spark.createDataFrame([("abcdefgh", 1), ("abcdefgi", 10), ("abcdefgj", 10), ("abcdefgé", 9)], "word string, n long")
    got = {r["word"]: (r["form"], r["form_n"], r["n_near"]) for r in spelling.group_variants(words).collect()}
    assert got == {"abcdefgh": ("abcdefgi", 10, 3), "abcdefgi": (None, None, 3), "abcdefgj": (None, None, 3), "abcdefgé": (None, None, 3)}


def test_vocabulary_of_all_documents(spark):
    """The counts of the whole table against DuckDB (without the letters taken out, which need a crc32)."""
    con = duckdb.connect()
    want = con.execute("SELECT word, count(*) FROM (SELECT translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word FROM '/root/testdata/sf0.01/documents.parquet') GROUP BY 1").fetchall()
    assert {tuple(r) for r in spelling.occurrences(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()} == set(want)


# --- the agenda's own ids; the prior without held-out labels


def test_the_agendas_ids_stand_unless_the_library_differs():
    import public_tokenizers

    from utrflow.llm.piece_codec import PieceCodec

    c = PieceCodec(public_tokenizers.path("piece_bpe_32k.model"))
    segments = [b" hello", b" world", b"!", b" strange"]
    got = np.array([7, 8, 9, 10, 11], np.int64)
    lengths = np.array([2, 1, 1, 1], np.int64)
    ids, n = c._settled(got, lengths, [[7, 8], [9], [10], [11]])
    assert ids is got and n is lengths and c.unequal == 0
    ids, n = c._settled(got, lengths, [[7, 8], [1, 2, 3], [10], [11]])  # one segment of four differs
    assert ids.tolist() == [7, 8, 1, 2, 3, 10, 11] and n.tolist() == [2, 3, 1, 1] and c.unequal == 1
    real, counts = c._ids(segments)
    assert c.unequal == 1  # the agenda agrees with the library on them

    class Broken:
        def encode(self, texts, **more):
            return [[5] for _ in texts] if isinstance(texts, list) else [5]

    library, c.library, c._checked = c.library, Broken(), lambda segments, got, lengths: (got, lengths)
    mine, own = c._ids(segments)  # whatever the library says, what the agenda gives is this
    assert mine.tolist() == real.tolist() and own.tolist() == counts.tolist()


def test_prior_is_chosen_within_the_sample(spark):
    from utrflow.llm import toxicity

    r = np.random.default_rng(1)
    toxic, clean = (r.random((300, 20)) < np.where(np.arange(20) < 10, 0.6, 0.2)).astype(np.uint8), (r.random((900, 20)) < 0.2).astype(np.uint8)
    mixed = np.concatenate([clean, (r.random((100, 20)) < np.where(np.arange(20) < 10, 0.6, 0.2)).astype(np.uint8)])
    prior = toxicity.likeliest_prior(toxic, mixed, 0.1)
    assert prior in {0.1, 0.125, 0.15000000000000002, 0.2}
    assert toxicity.likeliest_prior(toxic[:2], mixed, 0.1) == 0.1 and toxicity.likeliest_prior(toxic, mixed, 0.5) == 0.5
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.fit(docs, x) for x in (labels, turned))
    assert a[2] == b[2] and np.array_equal(a[0], b[0]) and np.allclose(a[1], b[1])


# --- licences by a share of the template's words; one long conversation in many tasks


def test_a_few_words_of_a_template_are_no_label(spark):
    from utrflow.llm import licenses

    df = spark.createDataFrame([(0, "mit license"), (1, "Released under the MIT License."), (2, None), (3, "released under some other licence of mit")], "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(df).collect()}
    assert got == {0: ("", 0.0), 1: ("mit", 1.0), 2: ("", 0.0), 3: ("", 0.0)}


def test_one_conversation_of_all_rows(spark):
    from utrflow.llm import quotes

    r = random.Random(6)
    rows = [(1, t, r.choice(["user", "assistant"]), f"message {t} says {t * 7}" + (f"\n> message {r.randrange(t)} says nothing" if t % 5 == 3 else f"\n> message {t // 2} says {t // 2 * 7}" if t % 3 == 2 else "")) for t in range(1500)]
    rows += [(1, 3, "user", "message 3 says 21"), (None, None, None, None), (None, 4, "user", "a"), (None, 4, "user", "a"), (2, 0, "user", "b")]
    got = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)).collect()
    assert len(got) == len(rows)
    for name, n in ((1, 1501), (None, 3), (2, 1)):
        own = sorted((x for x in got if x["conv_id"] == name), key=lambda x: x["position"])
        assert [x["position"] for x in own] == list(range(n))
        key = lambda x: (x["depth"], x["turn"] is not None, x["turn"] or 0, x["role"] or "", x["text"] or "")
        assert [key(x) for x in own] == sorted(map(key, own))
    depth = {x["turn"]: x["depth"] for x in got if x["conv_id"] == 1}
    for x in got:
        if x["conv_id"] == 1 and x["turn"]:
            want = x["turn"] // 2 if x["turn"] % 3 == 2 and x["turn"] % 5 != 3 else x["turn"] - 1
            assert x["reply_to"] == want and x["depth"] == depth[want] + 1


def test_values_of_one_text_meet_its_terms_once(spark, monkeypatch):
    """A text with many addresses of its own: as many pairs as it has rare terms, and the result that each address alone gives."""
    from utrflow.llm import pii

    common = "plain ordinary words that every text here holds"
    many = " ".join(f"user{i}@mail{i}.org" for i in range(60))
    docs = [(0, f"{common} secretive {many}"), (1, f"{common} shared@both.org peculiar"), (2, f"{common} shared@both.org peculiar other@two.org")] + [(3 + i, f"{common} {i} number") for i in range(40)]
    made = {}
    real = pii.written
    monkeypatch.setattr(pii, "written", lambda df, name: made.setdefault(name, real(df, name)))
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert made["pairs"].filter("pair like 'secretive%'").count() == 1
    monkeypatch.undo()
    alone = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame([(0, f"{common} secretive user0@mail0.org"), *docs[1:]], "doc_id long, text string")).collect()}
    start = len(common) + 1
    assert f"term:{start}:{start + 9}" in got[0] and f"term:{start}:{start + 9}" in alone[0] and got[1] == alone[1] and got[2] == alone[2]
    assert got[1].count("term") == 1 and got[3] == ""


# --- the distributed paths of earlier operators


def test_the_two_bloom_passes(spark, monkeypatch):
    """With no hashes counted on the driver, both passes run in tasks and are added up by segment."""
    from utrflow.llm import bloom, exact_dedup

    monkeypatch.setattr(bloom, "FEW", 0)
    r = random.Random(9)
    rows = [(i, f"text number {r.randrange(3000)}" + ("  " if i % 3 else " ") + "end") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), []).append(i)
    got = {x["doc_id"]: (x["keep_id"], x["group_size"], x["kept"]) for x in exact_dedup.dedup_index(df).collect()}
    assert got == {i: (min(g), len(g), i == min(g)) for g in groups.values() for i in g}
    hashed = spark.createDataFrame([(i % 500,) for i in range(700)] + [(None,)], "h long").repartition(4)
    bits = np.frombuffer(bloom.repeated_filter(hashed, "h", 701), np.uint8)
    hit = bloom.hits(bits, np.arange(500, dtype=np.int64), bloom.cells_for(701))
    assert hit[:200].all() and hit[200:].mean() < 0.05  # those that occur twice, always; the others, seldom


def test_the_join_with_every_list_long(spark, monkeypatch):
    """With all lists treated as long, the links are the same."""
    from utrflow.llm import ngram_join

    r = random.Random(12)
    base = [" ".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(6, 40))) for _ in range(25)]
    docs = [(i, t) for i, t in enumerate(t if r.random() < 0.4 else " ".join(w if r.random() > 0.02 else "z" for w in t.split()) for t in base for _ in range(4))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    plain = {x["doc_id"]: x["component_id"] for x in ngram_join.jaccard_components(df).collect()}
    monkeypatch.setattr(ngram_join, "LONG_LIST", 1)
    assert {x["doc_id"]: x["component_id"] for x in ngram_join.jaccard_components(df).collect()} == plain and len(set(plain.values())) < 100


def test_packed_windows(spark):
    """Windows have 1024 places at most, are gapless, and few places stay empty."""
    import public_tokenizers

    from utrflow.llm import packing

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    windows, pieces = {}, {}
    for x in rows:
        windows.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
        pieces.setdefault(x["doc_id"], []).append((x["start"], x["length"], x["doc_tokens"]))
    empty = 0
    for own in windows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
        empty += 0 if at & (at - 1) == 0 else 1024 - at  # a power of two stays as it is
    assert empty <= 0.02 * sum(x["length"] for x in rows)
    for own in pieces.values():
        at = 0
        for start, length, _ in sorted(own):
            assert start == at
            at += length
        assert at == own[0][2]
