"""Personal data by patterns, and by what terms disclose about it: information-theoretic sanitisation in DataFrame functions.

Base spans are e-mail addresses, IPv4 addresses, card and phone numbers. The terms of all texts that hold a value are tested
against the whole corpus: if seeing the term tells nearly as much as the value itself (pointwise mutual information of at
least the value's information content over ``alpha``), it is disclosing and becomes a span, too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utrflow.plans.storage import join_sized, written

#: The four patterns. Possessive quantifiers and the look-behind (or the end of the last match) only spare
#: attempts that cannot succeed; the matches are those of the plain patterns.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for the pattern to be tried.
SIGNS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
TERM = r"\p{L}{4,}+"
ALPHA = 1.25
#: Added to each count of texts with or without a term, so that small counts tell less than they seem to.
SMOOTH = 0.5


def matches(text: Column, pattern: str, keep: Callable[[Column], Column] = lambda value: F.lit(True)) -> Column:
    """An array of (start, end, value) of the pattern's matches to keep, in code points, end exclusive."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")

    def step(done: Column, part: Column) -> Column:
        start = done["at"] + F.length(part["gap"])
        end = start + F.length(part["hit"])
        return F.struct(F.coalesce(end, start).alias("at"), F.when(part["hit"].isNull() | ~keep(part["hit"]), done["found"]).otherwise(F.array_append(done["found"], F.struct(start.alias("start"), end.alias("end"), part["hit"].alias("value")))).alias("found"))

    return F.aggregate(parts, F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("found")), step, lambda done: done["found"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    """Whether a match counts."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int") <= 255))
    n = F.length(_digits(value))
    if kind == "phone":
        return n.between(8, 15)
    if kind == "card":
        turned = F.transform(F.regexp_extract_all(F.reverse(_digits(value)), F.lit("[0-9]"), F.lit(0)), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
        return F.when(n.between(16, 19), F.aggregate(turned, F.lit(0), lambda a, d: a + d) % 10 == 0).otherwise(F.lit(False))
    return F.lit(True)


def _of_kind(text: Column, kind: str) -> Column:
    found = F.filter(matches(text, PATTERNS[kind]), lambda m: _valid(kind, m["value"]))
    return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))


def base_spans(text: Column) -> Column:
    """An array of (kind, start, end, value): the kinds in the order of PATTERNS, each by start; no null elements."""
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string>>")
    return F.concat(*[F.when(text.rlike(SIGNS[kind]), _of_kind(text, kind)).otherwise(none) for kind in PATTERNS])


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def discloses(both: Column, with_value: Column, with_term: Column, total: int, alpha: float) -> Column:
    """Whether a term tells so much about a value, from the numbers of texts with both, either and in all."""
    every = total + 2 * SMOOTH
    information = F.log2(every / (with_value + SMOOTH))
    mutual = F.log2((both + SMOOTH) / (with_value + 2 * SMOOTH) * every / (with_term + SMOOTH))
    return (with_value < total) & (mutual >= information / alpha)


def disclosing(found: DataFrame, corpus: DataFrame, text: str, alpha: float = ALPHA) -> DataFrame:
    """(digest, copies, terms): of each different text with values the terms (term, remove) that disclose one of them.

    ``found`` has digest, text and spans of the texts with values, ``corpus`` all texts (column ``text``). A term and a value
    occur together where one text holds both, however far apart; equal texts count once. Terms are words of at least four
    letters, in lower case.
    ``remove`` is true for terms that occur with no other value's text at all; the others can be generalised.
    A text meets its terms once for each class of its values, not for each value: its thousand addresses that stand nowhere
    else are one class.
    """
    own = written(found.groupBy("digest").agg(F.min(F.struct("text", "spans")).alias("d"), F.count(F.lit(1)).alias("copies")).select("digest", "copies", "d.*"), "found")
    none = own.limit(0).select("digest", "copies", F.array().cast("array<struct<term:string,remove:boolean>>").alias("terms"))
    if own.isEmpty():
        return none
    # values, terms and all are counted in different texts: copies tell nothing
    texts = corpus.filter(F.col(text).isNotNull()).groupBy(F.sha2(F.col(text), 256).alias("digest")).agg(F.first(text).alias("text"))
    words = written(texts.select(F.explode(F.array_distinct(_words(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("with_term")), "term_counts")
    total = corpus.filter(F.col(text).isNotNull()).select(F.sha2(F.col(text), 256)).distinct().count()
    values = written(own.select("digest", F.explode(F.array_distinct(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["value"])))).alias("key")), "values")
    # values that the same texts hold are one: their class is told by two hashes of the texts' set, no longer than a value
    one = lambda seed: F.lpad(F.conv(F.hex(F.bit_xor(F.xxhash64("digest", F.lit(seed)))), 16, 36), 13, "0")
    sizes = written(values.groupBy("key").agg(F.count(F.lit(1)).alias("with_value"), F.concat(one(1), one(2)).alias("class")), "value_counts")
    n, most = sizes.agg(F.sum("with_value"), F.max("with_value")).first()
    tokens = words.agg(F.sum("with_term")).first()[0] or 0
    # what no test can pass is left out before terms meet values: a term in more texts than even the commonest value allows,
    # then one that would fail with a value if all its texts held it
    rare = words.filter(F.col("with_term") + SMOOTH <= (most + SMOOTH) ** (1 / alpha) * (total + 2 * SMOOTH) ** (1 - 1 / alpha) * (1 + 1e-9))
    terms = join_sized(own.select("digest", F.explode(F.array_distinct(_words(F.col("text")))).alias("term")), rare, "term", "with_term", tokens).filter("with_term is not null")
    counts = lambda both: discloses(both, F.col("with_value"), F.col("with_term"), total, alpha)
    classes = join_sized(values, sizes, "key", "with_value", n).groupBy("digest", "class").agg(F.max("with_value").alias("with_value"))
    pairs = classes.join(terms, "digest").filter(counts(F.least("with_value", "with_term")))
    pairs = written(pairs.select("digest", F.concat_ws("\n", "term", "class").alias("pair"), "with_value", "with_term"), "pairs")
    tested = pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("both"), F.max("with_value").alias("with_value"), F.max("with_term").alias("with_term")).filter(counts(F.col("both")))
    tested = written(tested.select("pair", "both", (F.col("with_term") <= F.col("with_value")).alias("remove")), "terms")
    told = join_sized(pairs.select("digest", "pair"), tested, "pair", "both", pairs.count()).filter("remove is not null")
    by_text = told.groupBy("digest").agg(F.collect_set(F.struct(F.substring_index("pair", "\n", 1).alias("term"), "remove")).alias("terms"))
    return written(own.select("digest", "copies").join(by_text, "digest"), "disclosing")


def with_spans(df: DataFrame, text: str, keep: list[Column], alpha: float = ALPHA) -> tuple[DataFrame, DataFrame]:
    """(rows, terms): ``keep`` with spans, and text where there are any; the term spans of those rows, by row number."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(*keep, whole.alias("__text"), base_spans(whole).alias("__spans")).withColumn("__row", F.monotonically_increasing_id())
    rows = written(rows.withColumn("__text", F.when(F.size("__spans") > 0, F.col("__text"))), "spans")
    found = rows.filter("__text is not null").select("__row", F.col("__text").alias("text"), F.col("__spans").alias("spans"), F.sha2("__text", 256).alias("digest"))
    terms = disclosing(found, df, text, alpha)
    marked = join_sized(found, terms, "digest", "copies", found.count()).filter("terms is not null").withColumn("names", F.transform("terms", lambda t: t["term"])).withColumn("gone", F.transform(F.filter("terms", lambda t: t["remove"]), lambda t: t["term"]))
    named = matches(F.col("text"), TERM, lambda value: F.array_contains(F.col("names"), F.lower(value)))
    hits = F.filter(named, lambda m: ~F.exists("spans", lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"])))
    spans = F.transform(hits, lambda m: F.struct(F.lit("term").alias("kind"), m["start"].alias("start"), m["end"].alias("end"), F.when(F.array_contains(F.col("gone"), F.lower(m["value"])), F.lit("")).otherwise(F.lit("[TERM]")).alias("value")))
    return rows, marked.select("__row", spans.alias("__terms"))


def find_pii(df: DataFrame, text: str = "text", id_col: str = "doc_id", alpha: float = ALPHA) -> DataFrame:
    """One row for each row of ``df``: id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Null and empty texts have no spans (base_sha256 is that of the empty string). Ids may be null or repeat: each row stands
    for itself. Other columns are not read. An empty table gives no rows.
    """
    rows, terms = with_spans(df, text, [F.col(id_col).alias("__id")], alpha)
    # few rows have spans: the others need no join
    with_terms = rows.filter("__text is not null").join(terms, "__row", "left").unionByName(rows.filter("__text is null"), allowMissingColumns=True)
    count = lambda k: F.size(F.filter("__spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = spans_text(F.col("__spans"))
    both = F.when(F.size("__terms") > 0, F.concat_ws(",", base, spans_text(F.col("__terms")))).otherwise(base)
    return with_terms.select(F.col("__id").alias(id_col), *map(count, PATTERNS), F.sha2(base, 256).alias("base_sha256"), both.alias("spans"))


def sanitise(df: DataFrame, text: str = "text", alpha: float = ALPHA) -> DataFrame:
    """``df`` with its texts sanitised: values become [EMAIL], [IP], [CARD], [PHONE], disclosing terms [TERM] or nothing.

    All rows and columns stay; texts without spans (null ones, too) are as they were. Where spans overlap, the one that
    starts first is replaced and the other's rest with it.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__doc")
    rows, terms = with_spans(df, text, [own], alpha)
    marked = rows.filter("__text is not null").join(terms, "__row", "left")
    spans = F.array_sort(F.concat(F.transform("__spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("by"))), F.coalesce(F.transform("__terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("by"))), F.array())))

    def step(done: Column, s: Column) -> Column:
        fresh = s["start"] >= done["at"]
        gap = F.substring(F.col("__text"), (done["at"] + 1).cast("int"), F.greatest(F.lit(0), (s["start"] - done["at"]).cast("int")))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.when(fresh, F.concat(done["out"], gap, s["by"])).otherwise(done["out"]).alias("out"))

    clean = F.aggregate(spans, F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")), step, lambda d: F.concat(d["out"], F.substring(F.col("__text"), (d["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    replaced = marked.select(*[clean.alias(c) if c == text else F.col(f"__doc.`{c}`") for c in df.columns])
    return rows.filter("__text is null").select("__doc.*").unionByName(replaced)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _matches_sql(source: str, kind: str, pattern: str) -> str:
    """(id, kind, start, end, value) of a pattern's matches: what stands between them gives their places."""
    return rf"""SELECT id, '{kind}' AS kind, a + list_sum(list_transform(gaps[:n], lambda g: length(g))) AS start, value FROM (
        SELECT id, gaps, unnest(range(1, len(hits) + 1)) AS n, unnest(hits) AS value, unnest(list_transform(range(1, len(hits) + 1), lambda i: coalesce(list_sum(list_transform(hits[:i - 1], lambda h: length(h))), 0))) AS a
        FROM (SELECT id, regexp_split_to_array(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS hits FROM {source}))"""


_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text, text IS NOT NULL AS given FROM documents),
m AS ({" UNION ALL ".join(_matches_sql("d", kind, pattern) for kind, pattern in _PLAIN.items())}),
g AS (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS digits FROM m),
b AS (SELECT id, kind, start, start + length(value) AS stop, value, list_position(['email', 'ip', 'card', 'phone'], kind) AS k FROM g WHERE CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN len(list_filter(string_split(value, '.'), lambda p: coalesce(try_cast(p AS HUGEINT), 999) > 255)) = 0
    WHEN 'card' THEN length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(range(0, length(digits)), lambda i: CASE WHEN i % 2 = 0 THEN reverse(digits)[i + 1]::INT ELSE reverse(digits)[i + 1]::INT * 2 - CASE WHEN reverse(digits)[i + 1]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0
    ELSE length(digits) BETWEEN 8 AND 15 END),
s AS (SELECT id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY k, start) AS base, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone FROM b GROUP BY id),
t AS (SELECT text, min(id) AS id FROM d WHERE given GROUP BY text),
n AS (SELECT count(*) AS total FROM t),
w AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(text), '\p{{L}}{{4,}}')) AS term FROM t),
wt AS (SELECT term, count(*) AS with_term FROM w GROUP BY term),
v AS (SELECT DISTINCT id, kind || ':' || value AS key FROM b WHERE id IN (SELECT id FROM t)),
wv AS (SELECT key, count(*) AS with_value FROM v GROUP BY key),
p AS (SELECT term, key, count(*) AS both_ FROM w JOIN v USING (id) GROUP BY ALL),
x AS (SELECT term, key FROM p JOIN wt USING (term) JOIN wv USING (key) CROSS JOIN n WHERE with_value < total AND log2((both_ + {SMOOTH}) / (with_value + {2 * SMOOTH}) * (total + {2 * SMOOTH}) / (with_term + {SMOOTH})) >= log2((total + {2 * SMOOTH}) / (with_value + {SMOOTH})) / {ALPHA}::DOUBLE),
o AS (SELECT DISTINCT t.text, term FROM x JOIN v USING (key) JOIN w USING (id, term) JOIN t USING (id)),
e AS (SELECT d.id, d.text FROM d JOIN s USING (id)),
u AS ({_matches_sql("e", "term", "\\p{L}{4,}")}),
h AS (SELECT u.id, string_agg('term:' || start || ':' || (start + length(value)), ',' ORDER BY start) AS terms FROM u JOIN e USING (id) JOIN o ON o.text = e.text AND o.term = lower(value)
    WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.id = u.id AND b.start < u.start + length(u.value) AND u.start < b.stop) GROUP BY u.id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, concat_ws(',', coalesce(base, ''), terms) AS spans
FROM d LEFT JOIN s USING (id) LEFT JOIN h USING (id)
"""
