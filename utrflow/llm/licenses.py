"""Licence scans by a positional index of rare words, in DataFrame functions.

The templates' words have postings (template, position). Of each template the words with the highest inverse document
frequency over the corpus are looked up in each file, at all their places; postings that agree on the offset between text and template support a candidate,
and a candidate whose mandatory key phrases all stand in the text becomes a label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from utrflow.plans.storage import written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label, template, mandatory key phrases. Grants and notices as licences word them.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["except in compliance with the license", "apache org licenses"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "licensed under the gnu affero general public license", ["affero general public license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", ["mozilla public license"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-nc-4.0", "creative commons attribution noncommercial 4 0 international", ["attribution noncommercial 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-4.0", "creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc0", "creative commons cc0 1 0 universal public domain dedication", ["cc0 1 0 universal"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify and or distribute"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
]
#: Of each template so many words of the highest inverse document frequency are looked up, at all their places in a text.
LOOKED_UP = 8
#: A candidate needs so great a share of the template's looked-up words at one offset.
AGREE = 0.5


def _lower(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """The words of the text in lower case (A-Z only); none for null."""
    return F.filter(F.split(_lower(text), GAP, -1), lambda w: w != "")


def _places(all_words: Column, phrase: str) -> Column:
    """The positions (from 0) at which the phrase's words stand one after another."""
    want = phrase.split(" ")
    first = F.filter(F.transform(all_words, lambda w, i: F.when(w == want[0], i)), lambda i: i.isNotNull())
    return F.filter(first, lambda i: F.slice(all_words, i + 1, len(want)) == F.array(*map(F.lit, want)))


def _base(all_words: Column) -> Column:
    """An array of (start, label) of all places of base phrases."""
    return F.concat(*[_labelled(all_words, p, label) for p, label in BASE.items()])


def _labelled(all_words: Column, phrase: str, label: str) -> Column:
    return F.transform(_places(all_words, phrase), lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))


def postings(spark: SparkSession, templates: list = TEMPLATES) -> DataFrame:
    """(word, template, position, length): as many rows as the templates have words."""
    rows = [(w, t, i, len(text.split())) for t, (_, text, _) in enumerate(templates) for i, w in enumerate(text.split())]
    return spark.createDataFrame(rows, "word string, template int, position int, length int").coalesce(1)


def scan(df: DataFrame, text: str = "text", id_col: str = "doc_id", templates: list = TEMPLATES, looked_up: int = LOOKED_UP, agree: float = AGREE) -> DataFrame:
    """One row for each row of ``df``: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the greatest agreement of a label of the index, 1 with base labels only, 0 without labels. Null and empty
    texts have no words, null first_word and last_word, empty labels. Ids may be null or repeat: each row stands for
    itself. Other columns aren't read. An empty table gives no rows.
    """
    spark = df.sparkSession
    vocabulary = sorted({w for _, t, _ in templates for w in t.split()})
    known = F.array(*map(F.lit, vocabulary))
    # a text without the longest word of any mandatory or base phrase gets no label: its words needn't be kept
    signs = sorted({max(p.split(), key=len) for p in [*BASE, *(phrases[0] for _, _, phrases in templates)]})
    lowered = df.select(F.col(id_col).alias("__id"), F.split(_lower(F.col(text)), GAP, -1).alias("__parts"))
    counted = lowered.withColumn("n_words", (F.size("__parts") - (F.element_at("__parts", 1) == "").cast("int") - ((F.size("__parts") > 1) & (F.element_at("__parts", -1) == "")).cast("int")).cast("long"))
    # the arrays of whole texts stay only where words of licences are in them
    rows = counted.select("__id", "n_words", F.when(F.arrays_overlap("__parts", F.array(*map(F.lit, signs))), F.filter("__parts", lambda w: w != "")).alias("__words")).withColumn("__row", F.monotonically_increasing_id())
    rows = written(rows, "words")
    frequency = written(df.select(F.explode(F.array_intersect(F.split(_lower(F.col(text)), GAP, -1), known)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("texts")), "licence_words")
    total = rows.count()
    found = rows.filter("__words is not null")
    idf = F.broadcast(frequency.select("word", F.log(F.lit(1.0 * max(total, 1)) / F.col("texts")).alias("idf")))
    rarest = Window.partitionBy("template").orderBy(F.desc("idf"), "word", "position")
    index = postings(spark, templates).join(idf, "word").withColumn("n", F.row_number().over(rarest)).filter(F.col("n") <= looked_up).drop("n", "idf")  # of a fixed size, as are the vocabulary's frequencies
    hits = found.select("__row", F.posexplode("__words").alias("at", "word")).join(F.broadcast(index), "word")
    candidates = hits.groupBy("__row", "template", (F.col("at") - F.col("position")).alias("offset")).agg(F.countDistinct("position").alias("same"), F.first("length").alias("length"))
    best = candidates.groupBy("__row", "template").agg(F.max("same").alias("same"), F.first("length").alias("length"))
    likely = best.withColumn("share", F.least(F.lit(1.0), F.col("same") / F.least("length", F.lit(looked_up)))).filter(F.col("share") >= agree)
    per_row = likely.groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("template", "share"))).alias("__likely"))
    labelled = found.join(per_row, "__row", "left")
    present = {}
    for _, _, phrases in templates:
        present |= {p: F.size(_places(F.col("__words"), p)) > 0 for p in phrases}
    own = []
    for t, (label, _, phrases) in enumerate(templates):
        share = F.col("__likely")[t]
        ok = share.isNotNull()
        for p in phrases:
            ok = ok & present[p]
        own.append(F.when(ok, F.struct(F.lit(label).alias("label"), share.alias("share"))))
    labelled = labelled.select("__row", "__id", "n_words", _base(F.col("__words")).alias("__base"), F.filter(F.array(*own), lambda x: x.isNotNull()).alias("__own"))
    nothing = rows.filter("__words is null").select("__row", "__id", "n_words")
    joined = labelled.unionByName(nothing, allowMissingColumns=True)
    base = F.coalesce(F.col("__base"), F.array().cast("array<struct<start:int,label:string>>"))
    mine = F.coalesce(F.col("__own"), F.array().cast("array<struct<label:string,share:double>>"))
    names = lambda a: F.transform(a, lambda x: x["label"])
    line = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    score = F.coalesce(F.array_max(F.transform(mine, lambda x: x["share"])), F.when(F.size(base) > 0, 1.0).otherwise(0.0))
    return joined.select(
        F.col("__id").alias(id_col), "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["start"])).cast("long").alias("last_word"),
        line(names(base)).alias("base_labels"), line(F.concat(names(base), names(mine))).alias("labels"), score.alias("score"),
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


OP7_SQL = rf"""
WITH t AS (SELECT * FROM (VALUES {", ".join(f"({n}, '{label}', '{text}', [{_quoted(phrases)}])" for n, (label, text, phrases) in enumerate(TEMPLATES))}) AS t(template, label, words, phrases)),
p AS (SELECT template, len(string_split(words, ' ')) AS length, unnest(string_split(words, ' ')) AS word, unnest(range(0, len(string_split(words, ' ')))) AS position FROM t),
w AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS line FROM w),
f AS (SELECT word, count(*) AS texts FROM (SELECT DISTINCT id, unnest(w) AS word FROM d) WHERE word IN (SELECT word FROM p) GROUP BY word),
i AS (SELECT p.* FROM p JOIN f USING (word) QUALIFY row_number() OVER (PARTITION BY template ORDER BY texts, p.word, position) <= {LOOKED_UP}),
u AS (SELECT id, unnest(w) AS word, unnest(range(0, len(w))) AS place FROM d),
h AS (SELECT id, template, position, length, place - position AS shift FROM u JOIN i USING (word)),
c AS (SELECT id, template, shift, count(DISTINCT position) AS same, any_value(length) AS length FROM h GROUP BY ALL),
k AS (SELECT id, template, max(same) AS same, any_value(length) AS length FROM c GROUP BY ALL),
o AS (SELECT id, label, least(1.0::DOUBLE, same / least(length, {LOOKED_UP})) AS share FROM k JOIN t USING (template) JOIN d USING (id) WHERE same / least(length, {LOOKED_UP}) >= {AGREE} AND len(list_filter(phrases, lambda x: NOT contains(line, ' ' || x || ' '))) = 0),
q AS (SELECT id, list(DISTINCT label) AS labels, max(share) AS share FROM o GROUP BY id),
b AS (SELECT id, doc_id, w, {", ".join(f"list_filter(range(0, len(w)), lambda x: array_to_string(w[x + 1:x + {len(phrase.split())}], ' ') = '{phrase}') AS b{n}" for n, phrase in enumerate(BASE))} FROM d),
z AS (SELECT id, doc_id, len(w) AS n_words, {" || ".join(f"b{n}" for n in range(len(BASE)))} AS places, list_filter([{", ".join(f"CASE WHEN len(b{n}) > 0 THEN '{label}' END" for n, label in enumerate(BASE.values()))}], lambda x: x IS NOT NULL) AS base FROM b)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word, array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(base || coalesce(labels, []))), ',') AS labels, coalesce(share, CASE WHEN len(base) > 0 THEN 1 ELSE 0 END)::DOUBLE AS score
FROM z LEFT JOIN q USING (id)
"""
