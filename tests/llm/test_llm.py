"""The llm operators against brute force, libraries, and odd rows."""

import collections
import gzip
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from utrflow.llm import curves, exact_dedup, licenses, ngram_join, packing, pii, piece_codec, queries, quotes, toxicity, warc
from utrflow.llm.agenda import Merges

SF = "/root/testdata/sf0.001"
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n\t", "a", "a  b", "a b", "A\x0bb", "é" * 50, "x" * 50_000, "the end. " * 3000, "日本 😀 ﬁ", "it's 'll 12 ½ !?\r\n", "one two three four five six seven", "one two three four five six seven", "One two three four five six SEVEN"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i != 4 else None, t, "kept", i) for i, t in enumerate(ODD)] + [(14, ODD[14], "again", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, group_size string, score int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(queries.ORACLE_SQL[name])
    want, names = cursor.fetchall(), [c[0] for c in cursor.description]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted((tuple(r[c] for c in names) for r in queries.QUERIES[name](spark, SF).collect()), key=key) == sorted(map(tuple, want), key=key)


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert exact_dedup.dedup_index(empty).count() == 0 and exact_dedup.exact_dedup(empty).columns == empty.columns
    assert ngram_join.jaccard_components(empty).count() == 0
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0
    assert pii.find_pii(empty).count() == 0 and licenses.scan(empty).count() == 0
    assert packing.pack(empty, BPE).count() == 0 and piece_codec.encode_texts(empty, PIECES).count() == 0
    assert curves.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert quotes.link_quotes(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_dedup_odd_rows(odd):
    rows = exact_dedup.dedup_index(odd).collect()
    assert len(rows) == len(ODD) + 1 and sum(r["kept"] for r in rows) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in ODD})
    same = [r for r in rows if r["group_size"] == 3]
    assert {r["keep_id"] for r in same} == {13} and sum(r["kept"] for r in same) == 1
    kept = exact_dedup.exact_dedup(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r["kept"] for r in rows)


def test_dedup_of_repeated_rows_keeps_one(spark):
    df = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text"), "id").repartition(8)
    assert exact_dedup.exact_dedup(df).count() == 1
    assert exact_dedup.dedup_index(df).filter("kept").count() == 1


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return set() if not words else {tuple(words)} if len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_components(docs):
    sets, root = {i: shingles(t) for i, t in docs}, {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and (n := len(sets[a] & sets[b])) and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_join_equals_brute_force(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    common, docs = [f"c{i}" for i in range(40)], []
    for g in range(12):  # groups of near copies at all distances, passages that all share, short texts
        base = [r.choice(words) for _ in range(r.randint(3, 120))]
        for _ in range(r.randint(1, 14)):
            copy = [w if r.random() > r.choice([0, 0.01, 0.03, 0.06]) else r.choice(words) for w in base]
            docs.append(" ".join(copy[: len(copy) - r.randint(0, 8)] + (common if r.random() < 0.3 else [])))
    docs = list(enumerate(docs + ["", None, "a b", "A  b", "a b c"]))
    got = ngram_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got.collect()} == brute_components(docs)


def test_join_odd_rows(odd):
    rows = ngram_join.jaccard_components(odd).collect()
    assert len(rows) == len(ODD) + 1
    assert {r["component_id"] for r in rows if r["doc_id"] in (13, 14, 15)} == {13}
    kept = ngram_join.keep_first(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id in (13, 14, 15)").count() == 1 and kept.filter("doc_id is null").count() == 1


def test_toxicity(spark, odd):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").filter("held_out").toPandas()
    ranks, n = rows["score"].rank(), int((rows["toxic"] == 1).sum())
    auc = (ranks[rows["toxic"] == 1].sum() - n * (n + 1) / 2) / n / (len(rows) - n)
    assert auc > 0.8
    scored = toxicity.score(odd, model).collect()
    assert len(scored) == len(ODD) + 1 and all(0 <= r["score"] <= 1 for r in scored)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in scored)
    assert toxicity.keep_clean(docs, model).columns == docs.columns


def test_labels_that_are_held_out_change_nothing(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    for a, b in zip(toxicity.fit(docs, labels), toxicity.fit(docs, turned), strict=True):
        assert np.array_equal(a, b)


def test_arc_forms():
    for version in (1, 2):
        data = warc.arc_file([("http://a.b/c d", "20010203040506", "text/html", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody"), ("dns:a.b", "200102030405", "text/dns", b"x\n")], version)
        first, page, dns = warc.arc_records(data)
        assert first.fields["URL"].startswith("filedesc:") and page.fields["URL"] == "http://a.b/c%20d"
        c = warc.converted(page)
        assert (c["kind"], c["payload"], c["date"]) == ("response", b"body", "2001-02-03T04:05:06Z") and c["payload_digest"] == hashlib.sha256(b"body").hexdigest()
        assert warc.converted(dns)["kind"] == "resource" and warc.converted(dns)["date"] == "2001-02-03T04:05:00Z"
    with pytest.raises(ValueError):
        list(warc.arc_records(data[:-5]))


def test_warc_odd_pages(spark, tmp_path):
    body = "é" * 60
    pages = spark.createDataFrame([(3, "http://x/", body), (1, None, body), (1, "http://x y/", body), (None, "http://z/", body), (5, "http://s/", "short"), (6, "http://s/", "short"), (7, "u", None), (8, "", "")], "page_id long, url string, html string")
    records = warc.arc_to_records(warc.pages_to_arc(pages, version=2))
    warc.write_warc(records, str(tmp_path / "w"))
    rows = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert len(rows) == 8 and all(r["sound"] for r in rows)
    for data in filter(None, (p.read_bytes() for p in (tmp_path / "w").glob("part-*"))):  # a task without records leaves an empty file
        members, at = [], data
        while at:
            one = zlib.decompressobj(31)
            members.append(one.decompress(at))
            at = one.unused_data
        assert b"WARC-Type: warcinfo" in members[0] and all(x.startswith(b"WARC/1.1") and x.count(b"WARC-Type: ") == 1 or not x for x in members)
    same = [r for r in rows if r["payload_bytes"] == 120]
    assert sorted(r["record_type"] for r in same) == ["response", "revisit", "revisit", "revisit"] and {r["refers_to"] for r in same if r["record_type"] == "revisit"} == {1}
    assert all(r["record_type"] == "response" for r in rows if r["payload_bytes"] < 100)


def test_warc_small_payloads_beside_repeated_ones(spark, tmp_path):
    body = "x" * 120
    rows = [(i, f"http://x/{i}", body if i % 3 else f"{i}") for i in range(3000)] + [(3000, "filedesc://x", "y" * 100), (3001, "filedesc://z", "y" * 100)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(map(tuple, warc.op4_warc(spark, str(tmp_path)).collect())) == sorted(con.execute(warc.OP4_SQL).fetchall())


def test_warc_that_was_changed_is_not_sound(spark, tmp_path):
    pages = spark.createDataFrame([(i, "http://x/", f"{i} " * 90) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    warc.write_warc(warc.arc_to_records(warc.pages_to_arc(pages)), str(tmp_path / "w"), size=10)
    files = [p for p in sorted((tmp_path / "w").glob("part-*")) if p.stat().st_size]
    assert len(files) == 3 and all(b"WARC-Type: warcinfo" in gzip.decompress(p.read_bytes())[:100] for p in files)  # bounded by rows and bytes
    text = gzip.decompress(files[0].read_bytes())
    files[0].write_bytes(gzip.compress(re.sub(rb"(\d) \1 ", rb"\1 x ", text, count=1)))
    for crc in (tmp_path / "w").glob(".*.crc"):
        crc.unlink()
    rows = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert len(rows) == 20 and [r["sound"] for r in rows].count(False) == 1
    empty = pages.limit(0)
    warc.write_warc(warc.arc_to_records(warc.pages_to_arc(empty)), str(tmp_path / "e"))
    clash = pages.withColumns({"kept": F.lit(1), "keep_id": F.lit("x"), "payload": F.lit(2)})
    assert warc.arc_to_records(warc.pages_to_arc(clash)).count() == 20


def brute_spans(text):
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, pattern in plain.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(d[::-1])) % 10 == 0
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 16 <= len(d) <= 19 and luhn or kind == "phone" and 8 <= len(d) <= 15:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_equals_brute_force(spark):
    r = random.Random(8)
    parts = ["a@b", "a.b@c.d", "@", ".", "1.2.3.4", "255.1.1.256", "+1", "4111 1111 1111 1111", "4111111111111111", "-", " ", "7", "é", "😀", "(", "x", "000", "+49 (30) 1234567", "a@b.c@d.e"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 20))) for _ in range(800)] + [None, "", "1." * 3000, "a@b" + ".c" * 3000]
    got = {x["doc_id"]: x for x in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        want = brute_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert got[i]["spans"].split(",")[: len(want)] == (want or got[i]["spans"].split(",")[:0])


def test_disclosing_terms(spark):
    filler = [(i, f"ordinary words number {i} without anything of note in them") for i in range(200)]
    near = [(1000 + i, f"case {chr(97 + i)} the Zanzibari consul bob@x.org called ordinary words") for i in range(5)]
    df = spark.createDataFrame(filler + near, "doc_id long, text string").withColumn("extra", F.lit(1))
    rows = {r["doc_id"]: r["spans"] for r in pii.find_pii(df).collect()}
    assert "term:" in rows[1000] and rows[1000].startswith("email:") and rows[5] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert "Zanzibari" not in clean[1000] and "[EMAIL]" in clean[1000] and "ordinary words" in clean[1000] and clean[5] == filler[5][1]


def test_terms_of_a_value_in_one_text(spark):
    filler = [(i, f"ordinary words number {i} without anything of note in them") for i in range(300)]
    far = "Dear Zanzibari consul, " + "ordinary words " * 20 + "write to bob@x.org"
    df = spark.createDataFrame([*filler, (1000, far)], "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert clean[1000] == far.replace("Zanzibari", "").replace("consul", "").replace("Dear", "").replace("write", "").replace("bob@x.org", "[EMAIL]")
    assert clean[7] == filler[7][1]


def test_copies_do_not_hide_a_disclosing_term(spark):
    filler = [(i, f"ordinary words number {i} without anything of note in them") for i in range(300)]
    near = [(1000 + i, f"case {chr(97 + i)} the Zanzibari consul bob@x.org called ordinary words") for i in range(3)]
    copies = [(2000 + i, near[0][1]) for i in range(200)]
    df = spark.createDataFrame(filler + near + copies, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert len(clean) == 503 and clean[2000] == clean[1000]
    assert all("Zanzibari" not in clean[i] and "ordinary words" in clean[i] for i in (1000, 1001, 1002, 2199))


def test_licenses_equal_brute_force(spark):
    r = random.Random(5)
    some = "cc by general public license all rights reserved licensed under the gnu version 3 é ß - , CC BY all é".split()
    texts = [r.choice([" ", "\n", ", ", "-"]).join(r.choice(some) for _ in range(r.randint(0, 40))) for _ in range(300)] + [None, "", " ", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."]
    got = {x["doc_id"]: x for x in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        w = re.findall(licenses.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        found = [(k, label) for p, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        x = got[i]
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"]) == (len(w), len(found), min((k for k, _ in found), default=None), max((k for k, _ in found), default=None), ",".join(sorted({b for _, b in found})))
    assert got[len(texts) - 2]["labels"] == "apache-2.0" and got[len(texts) - 1]["labels"] == "mit"


def test_every_template_of_one_text_is_found(spark):
    every = " some words between ".join(t for _, t, _ in licenses.TEMPLATES)
    notice = licenses.TEMPLATES[4][1] + ". Licensed under the Apache License, Version 2.0."
    rows = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame([(0, every), (1, notice), (2, "ordinary words with the license")], "doc_id long, text string")).collect()}
    assert {label for label, _, _ in licenses.TEMPLATES} <= set(rows[0]["labels"].split(","))
    assert rows[1]["labels"] == "apache-2.0,bsd" and rows[2]["labels"] == ""


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24)).astype("f4")
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(i, x[0].tolist()) for i in range(5000, 5010)]
    rows += [(6000, None), (6050, [0.0] * 24), (6100, [float("nan")] * 24), (None, x[1].tolist()), (6150, [1.0, None]), (6200, [1.0, 2.0]), (6201, [2.0, 1.0])]
    got = collections.defaultdict(list)
    for r in curves.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert [i for i, _ in got[0]] == [5000, 5001, 5002, 5003, 5004] and [i for i, _ in got[6200]] == [6201]
    u = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    hits = 0
    for q in range(50, 3000, 50):
        s = u @ u[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:5].tolist()) & {i for i, _ in got[q]})
    assert hits >= 0.9 * 5 * 59 and not {6000, 6050, 6100} & set(got)


def test_repeated_rows_do_not_crowd_out_equal_vectors(spark):
    r = np.random.default_rng(3)
    rows = [(0, [1.0, 2.0, 3.0])] * 30 + [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0])] + [(i, [float(x) for x in r.normal(size=3)]) for i in range(3, 40)]
    got = curves.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=2, every=100).collect()
    assert [x["vec_id"] for x in sorted(got, key=lambda x: x["rank"]) if x["query_id"] == 0] == [1, 2]


def test_small_windows_find_clustered_neighbours(spark):
    r = np.random.default_rng(7)
    centres = r.normal(size=(120, 32))
    x = centres[r.integers(0, 120, 6000)] + r.normal(size=(6000, 32)) * 0.1
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    got = collections.defaultdict(set)
    # a window holds 300 of 6,000 rows on a curve
    for q in curves.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string"), share=0.05, least=300).collect():
        got[q["query_id"]].add(q["vec_id"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 6000, 50):
        s = u @ u[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:5].tolist()) & got[q])
    assert hits >= 0.9 * 5 * 120


def test_tiny_and_huge_vectors(spark):
    rows = [(0, [2.0**-600, 2.0**-599]), (1, [2.0**600, 2.0**601]), (2, [1e-300, 0.0]), (3, [-1.0, 5.0])]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in curves.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=1).collect()}
    assert len(got) == 12 and got[0, 1] == (1, pytest.approx(1)) and got[2, 1] == (0, pytest.approx(5**-0.5)) and got[2, 3] == (3, pytest.approx(-(26**-0.5)))


def test_hilbert_neighbours_touch():
    cells = np.array([[i >> 6 & 7, i >> 3 & 7, i & 7] for i in range(512)])
    order = np.argsort(curves.hilbert_keys(cells, 3))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def test_packing(odd):
    tokenizer = Tokenizer.from_file(BPE)
    tokenizer.encode_special_tokens = True
    rows = packing.pack(odd.filter("doc_id is not null and group_size = 'kept'"), BPE).toPandas()
    for i, t in enumerate(ODD):
        if i == 4:
            continue
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = rows[rows.doc_id == i].sort_values("start")
        assert own["length"].sum() == len(ids) and (own["doc_tokens"] == len(ids)).all()
        assert [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own.itertuples()] == own["ids_crc32"].tolist()
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (own["offset"] == own["length"].cumsum() - own["length"]).all() and own["length"].sum() <= 1024


def test_words_as_the_tokenizer_cuts_them():
    r, encoder = random.Random(3), packing.ByteLevelEncoder(BPE)
    parts = ["'s", "'ll", "'", " ", "  ", "\n", "\t", "a", "é", "1", "²", "!", "…", " ", "　", "😀", "日本", "́", "'t x", "''s", "<|endoftext|>", "\x00", "​", "\u0085"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(2000)]
    tokenizer = Tokenizer.from_file(BPE)
    tokenizer.encode_special_tokens = True
    want = tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [x.ids for x in want] == [x.tolist() for x in encoder.encode([t.encode() for t in texts])]


def test_added_tokens_as_the_library_loaded_gives_them():
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> it's", "plain <|endoftext| >", "", "é  <|endoftext|>\n\nx"]
    library = Tokenizer.from_file(BPE)
    got = packing.ByteLevelEncoder(BPE).encode_loaded([t.encode() for t in texts])
    assert [g.tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_piece_codec(odd):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = piece_codec.encode_texts(odd, PIECES).collect()
    texts = {i if i != 4 else None: t or "" for i, t in enumerate(ODD)}
    assert len(rows) == len(ODD) + 1
    for r in rows:
        assert r["ids"] == library.encode(texts[r["doc_id"]]) and r["decoded"] == library.decode(r["ids"]) and r["unequal"] == 0
    r, codec = random.Random(3), piece_codec.PieceCodec(PIECES)
    parts = ["the", " ", "  ", "\n", "a", "é", "1", "　", "😀", "日本", "▁", "\x00", "ion", "<s>", "x" * 300]
    many = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(2000)]
    ids, counts = codec.encode([t.encode() for t in many])
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == library.encode(many) and codec.unequal == 0
    assert [x.decode() for x in codec.decode(ids, counts)] == [library.decode(library.encode(t)) for t in many]


def test_lockstep_equals_agenda():
    r = np.random.default_rng(1)
    pairs = [(a, b) for a in range(12) for b in range(12) if r.random() < 0.5]
    m = Merges(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]), r.permutation(len(pairs)), r.integers(0, 12, len(pairs)))
    lengths = r.integers(0, 40, 300)
    symbols = r.integers(0, 12, lengths.sum())
    flat, n = m.run(symbols, lengths)
    assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == [m.one(x.tolist()) for x in np.split(symbols, np.cumsum(lengths)[:-1])]


def test_quotes(spark):
    rows = [(1, 0, "u", "Hello there.\nSecond line"), (1, 1, "a", "Fine, thanks"), (1, 2, "u", "> hello   THERE.\nI mean this"), (1, 3, "u", ">> Hello there.\n> I mean this\nok"), (1, 4, "a", None), (2, 0, "u", "x"), (None, 0, "u", "> z"), (None, None, "u", "z")]
    got = {(r["conv_id"], r["turn"]): r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == len(rows)
    assert (got[1, 2]["reply_to"], got[1, 2]["linked"], got[1, 2]["text"]) == (0, True, "I mean this")
    assert (got[1, 3]["reply_to"], got[1, 3]["max_level"], got[1, 3]["depth"], got[1, 3]["text"]) == (2, 2, 2, "ok")
    assert got[1, 4]["reply_to"] == 3 and got[2, 0]["reply_to"] is None and got[1, 0]["position"] == 0


def test_quotes_of_all_levels_and_of_parts(spark):
    first = "Opening line\nsecond line\nthird line\n\nA paragraph of\ntwo lines\n\nlast line"
    rows = [(1, 0, "u", first), (1, 1, "a", "thanks"), (1, 2, "u", ">> second line\nyes"), (1, 3, "a", "> second line\n> third line\nno"), (1, 4, "u", "> A paragraph\n> of two lines\nwell"), (1, 5, "a", "> nowhere\nx")]
    got = {r["turn"]: r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [(got[t]["linked"], got[t]["reply_to"]) for t in range(6)] == [(False, None), (False, 0), (True, 0), (True, 0), (True, 0), (False, 4)]


def test_planted_quotations_equal_sql(spark, tmp_path):
    r = random.Random(8)
    word = lambda: r.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) + str(r.randint(0, 30))
    rows, planted = [], {}
    for conv in [*range(40), None]:
        said: list[list[str]] = []
        for turn in range(r.randint(1, 14)):
            own = [" ".join(word() for _ in range(6)) if r.random() > 0.2 else "" for _ in range(r.randint(1, 5))] + [f"end {conv} {turn}"]
            head = []
            if said and r.random() < 0.6:
                source = r.randrange(len(said))
                lines = said[source]
                a = r.randrange(len(lines))
                part = lines[a : a + r.randint(1, 3)] if r.random() < 0.7 else lines
                mark = r.choice([">", "> ", ">> ", "> > "])
                head = [mark + x.upper() if r.random() < 0.3 else mark + x for x in part] + (["> nobody said this"] if r.random() < 0.2 else [])
                if part is lines:
                    planted[conv, turn] = source
            said.append(own)
            rows.append((conv, turn, r.choice(["user", "assistant"]), r.choice(["\n", "\r\n"]).join(head + own)))
    rows += [(3, None, "user", "> x"), (4, 2, "user", None), (5, 1, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "conversations"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations/*.parquet'")
    cursor = con.execute(quotes.OP5_SQL)
    names, want = [c[0] for c in cursor.description], cursor.fetchall()
    got = quotes.link_quotes(df.repartition(5)).collect()
    key = lambda x: tuple((v is None, str(v)) for v in x)
    assert sorted((tuple(x[c] for c in names) for x in got), key=key) == sorted(map(tuple, want), key=key)
    found = {(x["conv_id"], x["turn"]): x["reply_to"] for x in got if x["linked"]}
    assert len(planted) > 20 and all(found[k] == v for k, v in planted.items())


def test_null_conversations_link_and_clashing_columns_do_not_matter(spark):
    rows = [(None, 0, "a", "first line here", 1, 1), (None, 1, "b", "another", 1, 1), (None, 2, "a", "> first line here\nyes", 1, 1), (1, 0, "a", "x" * 100_000, 1, 1), (1, 1, "b", "> " + "x" * 100_000, 1, 1)]
    got = {(r["conv_id"], r["turn"]): r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv int, row int")).collect()}
    assert got[None, 2]["linked"] and got[None, 2]["reply_to"] == 0 and got[None, 2]["depth"] == 1 and got[None, 1]["reply_to"] == 0
    assert got[1, 1]["linked"] and got[1, 1]["text"] == ""


def test_depth_of_long_conversations(spark):
    rows = [(c, t, "u", f"> line {t - 1}\nline {t}" if c == 1 and t == 150 else f"line {t}") for c in (1, 2) for t in range(200)]
    got = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 400 and all(r["depth"] == r["turn"] == r["position"] for r in got)


def test_pipeline_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    clean = {r["doc_id"] for r in toxicity.score(docs, model).filter("predicted = 0").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in clean}
    first = {}
    for i in sorted(texts):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i] or ""), i)
    comps = brute_components([(i, texts[i]) for i in sorted(first.values())])
    kept = {i for i, (_, c) in comps.items() if c == i}
    rows = corpus_pipeline.run(spark, SF).toPandas()
    assert set(rows["doc_id"]) == kept
    assert (rows.groupby("doc_id")["length"].sum() == rows.groupby("doc_id")["doc_tokens"].first()).all()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "pii", "packing"]
