"""Quotation linking: conversations without their quotations, ordered by replies, in DataFrame functions.

Lines that start with > marks are quoted; the marks are the level. Consecutive quoted lines of one level are a passage.
Each passage is hashed in normalised form and looked up among the passages, paragraphs and lines that earlier messages of the
conversation wrote themselves, and where it is none of these, by its own paragraphs and lines; the message that wrote it is
what the quoting one replies to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from utrflow.plans.storage import join_sized, numbered, written

#: Fixed value of the format: the marks at the start of a quoted line.
MARKS = r"^[\x20\t]*((?:>[\x20\t]*)+)"


def _level(line: Column) -> Column:
    """The number of > marks that a line starts with."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), r"[^>]", ""))


def _normal(line: Column) -> Column:
    """What is compared: without marks, in lower case, white space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, MARKS, "")), r"[\x20\x09-\x0D]+", " "))


def passages(df: DataFrame) -> DataFrame:
    """(row, level, at, passage, units): every passage of every message (row, text), ``at`` its first line; level 0 is the message's own text.

    ``units`` are the passage's lines and its paragraphs, which blank lines end.
    """
    lines = df.select("row", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n", -1)).alias("at", "line"))
    order = Window.partitionBy("row").orderBy("at")
    lines = lines.select("row", "at", _level(F.col("line")).alias("level"), _normal(F.col("line")).alias("own")).withColumn("block", F.sum((F.col("own") == "").cast("int")).over(order)).filter("own != ''")
    runs = lines.withColumn("new", (F.coalesce(F.lag("level").over(order), F.lit(-1)) != F.col("level")).cast("int")).withColumn("run", F.sum("new").over(order))
    text = lambda found: F.array_join(F.transform(F.array_sort(found), lambda x: x["own"]), " ")
    parts = runs.groupBy("row", "run").agg(F.first("level").alias("level"), F.min("at").alias("at"), F.collect_list(F.struct("at", "own", "block")).alias("found"))
    blocks = F.transform(F.array_distinct(F.transform("found", lambda x: x["block"])), lambda b: text(F.filter("found", lambda x: x["block"] == b)))
    return parts.select("row", "level", "at", text(F.col("found")).alias("passage"), F.array_distinct(F.concat(F.transform("found", lambda x: x["own"]), blocks)).alias("units"))


def link_quotes(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each message: conv_id, turn, role, text (without quotations), n_quotes, max_level, linked, reply_to, depth, position.

    ``reply_to`` is the turn of the latest earlier message of the conversation that wrote a quotation of the message itself:
    whole, as one of its paragraphs or lines, or else the most of the quotation's paragraphs and lines. Of quotations whose
    source is found those of the lowest level count. Without such a quotation a message replies to the turn before it, the first to none
    (null). ``depth`` counts the replies above it. ``position`` (from 0) orders a conversation by depth, then
    turn, then role and text; messages that repeat in all of these are ordered arbitrarily. Null and empty texts have no
    quotations; null turns come first and are not replied to; null conversations are one of their own. Other columns
    aren't read. An empty table gives no rows.
    """
    # null conversations are one of their own: its key is the only one without a letter before it
    key = F.coalesce(F.concat(F.lit("c"), F.col(conv).cast("string")), F.lit(""))
    rows = written(df.select(F.col(conv).alias("name"), key.alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).withColumn("row", F.monotonically_increasing_id()), "messages")
    marked = rows.filter(F.col("text").rlike("(?m)" + MARKS))
    quoted = written(passages(marked.select("row", "text")), "quoted")
    counts = quoted.filter("level > 0").groupBy("row").agg(F.count(F.lit(1)).alias("n_quotes"), F.max("level").cast("long").alias("max_level"))
    # only conversations with quotations are taken apart
    sought = written(quoted.filter("level > 0").join(rows.select("row", "conv", "turn"), "row").select("row", "conv", "turn", "level", "at", F.sha2("passage", 256).alias("hash"), "units"), "sought")
    talks = sought.select("conv").distinct()
    sources = rows.filter("turn is not null").join(talks, "conv", "left_semi")
    own = passages(sources.select("row", "text")).filter("level = 0").select("row", F.explode(F.array_union(F.array("passage"), F.col("units"))).alias("passage"))
    written_by = written(own.join(sources.select("row", "conv", "turn"), "row").select("conv", F.col("turn").alias("source"), F.sha2("passage", 256).alias("hash")).distinct(), "sources")
    whole = written(sought.drop("units").join(written_by, ["conv", "hash"]).filter("turn is null or source < turn").groupBy("row", "level", "at").agg(F.max("source").alias("source")), "whole")
    pieces = sought.drop("hash").join(whole, ["row", "at"], "left_anti").select("row", "conv", "turn", "level", "at", F.explode("units").alias("unit")).withColumn("hash", F.sha2("unit", 256))
    shared = pieces.join(written_by, ["conv", "hash"]).filter("turn is null or source < turn").groupBy("row", "level", "at", "source").agg(F.count(F.lit(1)).alias("n"))
    most = shared.groupBy("row", "level", "at").agg(F.max(F.struct("n", "source")).alias("best")).select("row", "level", "at", "best.source")
    found = whole.unionByName(most).groupBy("row").agg(F.max(F.struct((-F.col("level")).alias("near"), "source")).alias("best")).select("row", F.col("best.source").alias("linked_to"))
    # turns are numbered by ranges, so that no task holds a whole conversation
    order = numbered(rows.select("conv", "turn").distinct(), ["conv", "turn"])
    ahead = order.select((F.col("number") + 1).alias("number"), F.col("conv").alias("c"), F.col("turn").alias("previous"))
    before = order.join(ahead, "number").filter("conv = c").select("conv", "turn", "previous")
    clean = F.trim(F.array_join(F.filter(F.split(F.col("text"), r"\r\n|\r|\n", -1), lambda line: _level(line) == 0), "\n"))
    joined = rows.join(before.filter("previous is not null").withColumnRenamed("turn", "t").withColumnRenamed("conv", "c"), (F.col("conv") == F.col("c")) & (F.col("turn") == F.col("t")), "left").drop("c", "t").join(counts, "row", "left").join(found, "row", "left")
    messages = written(joined.select("row", "name", "conv", "turn", "role", F.when(F.col("n_quotes").isNotNull(), clean).otherwise(F.col("text")).alias("text"), F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("max_level", F.lit(0)).cast("long").alias("max_level"), F.col("linked_to").isNotNull().alias("linked"), F.coalesce("linked_to", "previous").alias("reply_to")), "replies")
    # the depth: where all replies go to the turn before, it is the turn's rank; else the parents are followed by doubling
    turns = messages.groupBy("conv", "turn").agg(F.max("reply_to").alias("up"), F.max("linked").alias("any"))
    talk = order.groupBy("conv").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("many"))
    talk = written(talk.join(turns.groupBy("conv").agg(F.max("any").alias("tangled")), "conv"), "conversations")
    total = talk.agg(F.sum("many")).first()[0] or 0
    plain = join_sized(order, talk, "conv", "many", total).filter("not tangled").select("conv", "turn", (F.col("number") - F.col("first")).alias("depth"))
    hop = join_sized(turns, talk, "conv", "many", total).filter("tangled and turn is not null").select("conv", "turn", "up", F.col("up").isNotNull().cast("long").alias("steps"))
    while not hop.filter("up is not null").isEmpty():
        nexts = hop.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("up").alias("further"), F.col("steps").alias("more"))
        hop = written(hop.join(nexts, (F.col("conv") == F.col("c")) & (F.col("up") == F.col("t")), "left").select("conv", "turn", F.col("further").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), "hops")
    depths = plain.unionByName(hop.select("conv", "turn", F.col("steps").cast("long").alias("depth"))).select(F.col("conv").alias("c"), F.col("turn").alias("t"), "depth")
    placed = messages.join(depths, (F.col("conv") == F.col("c")) & F.col("turn").eqNullSafe(F.col("t")), "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    placed = numbered(placed.drop("c", "t"), ["conv", "depth", "turn", "role", "text", "row"])
    first = written(placed.groupBy("conv").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("many")), "first-messages")
    placed = join_sized(placed, first, "conv", "many", first.agg(F.sum("many")).first()[0] or 0).withColumn("position", F.col("number") - F.col("first"))
    return placed.select(F.col("name").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role), F.col("text").alias(text), "n_quotes", "max_level", "linked", "reply_to", "depth", "position")


def op5_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP5_SQL = r"""
WITH RECURSIVE c AS (SELECT row_number() OVER () AS id, conv_id AS conv, turn::BIGINT AS turn, role, text FROM conversations),
l0 AS (SELECT id, unnest(range(0, len(x))) AS place, unnest(x) AS line FROM (SELECT id, string_split_regex(coalesce(text, ''), '\r\n|\r|\n') AS x FROM c)),
l1 AS (SELECT *, length(regexp_replace(regexp_extract(line, '^[\x20\t]*((?:>[\x20\t]*)+)', 1), '[^>]', '', 'g')) AS level, trim(regexp_replace(lower(regexp_replace(line, '^[\x20\t]*((?:>[\x20\t]*)+)', '')), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS own FROM l0),
l2 AS (SELECT *, sum((own = '')::INT) OVER (PARTITION BY id ORDER BY place) AS block FROM l1),
l3 AS (SELECT *, (lag(level) OVER (PARTITION BY id ORDER BY place) IS DISTINCT FROM level)::INT AS fresh FROM l2 WHERE own <> ''),
l4 AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY place) AS run FROM l3),
pa AS (SELECT id, run, any_value(level) AS level, min(place) AS place, string_agg(own, ' ' ORDER BY place) AS passage FROM l4 GROUP BY id, run),
un AS (SELECT id, run, own AS unit FROM l4 UNION SELECT id, run, string_agg(own, ' ' ORDER BY place) FROM l4 GROUP BY id, run, block),
nq AS (SELECT id, count(*) AS n_quotes, max(level) AS max_level FROM pa WHERE level > 0 GROUP BY id),
src AS (SELECT DISTINCT c.conv, c.turn AS source, u.unit FROM (SELECT id, run, passage AS unit FROM pa UNION SELECT * FROM un) u JOIN pa USING (id, run) JOIN c USING (id) WHERE level = 0 AND c.turn IS NOT NULL),
wh AS (SELECT pa.id, pa.level, pa.place, max(source) AS source FROM pa JOIN c USING (id) JOIN src ON src.conv IS NOT DISTINCT FROM c.conv AND src.unit = pa.passage AND (c.turn IS NULL OR source < c.turn) WHERE level > 0 GROUP BY ALL),
ps AS (SELECT pa.id, pa.level, pa.place, source, count(*) AS n FROM pa JOIN un USING (id, run) JOIN c USING (id) JOIN src ON src.conv IS NOT DISTINCT FROM c.conv AND src.unit = un.unit AND (c.turn IS NULL OR source < c.turn) WHERE level > 0 AND NOT EXISTS (SELECT 1 FROM wh WHERE wh.id = pa.id AND wh.place = pa.place) GROUP BY ALL),
best AS (SELECT id, level, source FROM wh UNION ALL (SELECT id, level, source FROM ps QUALIFY row_number() OVER (PARTITION BY id, place ORDER BY n DESC, source DESC) = 1)),
li AS (SELECT id, source AS linked_to FROM best QUALIFY row_number() OVER (PARTITION BY id ORDER BY level, source DESC) = 1),
pv AS (SELECT conv, turn, lag(turn) OVER (PARTITION BY conv ORDER BY turn NULLS FIRST) AS previous FROM (SELECT DISTINCT conv, turn FROM c)),
cl AS (SELECT id, trim(string_agg(line, chr(10) ORDER BY place) FILTER (level = 0), ' ') AS clean FROM l1 GROUP BY id),
ms AS (SELECT c.id, c.conv, c.turn, c.role, CASE WHEN n_quotes IS NOT NULL THEN coalesce(clean, '') ELSE c.text END AS text, coalesce(n_quotes, 0) AS n_quotes, coalesce(max_level, 0) AS max_level, linked_to IS NOT NULL AS linked, coalesce(linked_to, previous) AS reply_to FROM c LEFT JOIN nq USING (id) LEFT JOIN li USING (id) LEFT JOIN cl USING (id) LEFT JOIN pv ON pv.conv IS NOT DISTINCT FROM c.conv AND pv.turn = c.turn),
tu AS (SELECT conv, turn, max(reply_to) AS up, max(linked::INT) AS linked FROM ms GROUP BY ALL),
tg AS (SELECT conv, turn, up, max(linked) OVER (PARTITION BY conv) = 1 AS tangled, dense_rank() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST) - 1 AS rank FROM tu),
dp AS (SELECT conv, turn, 0::BIGINT AS depth FROM tg WHERE tangled AND turn IS NOT NULL AND up IS NULL UNION ALL SELECT tg.conv, tg.turn, dp.depth + 1 FROM dp JOIN tg ON tg.conv IS NOT DISTINCT FROM dp.conv AND tg.up = dp.turn AND tg.tangled AND tg.turn IS NOT NULL),
al AS (SELECT conv, turn, rank AS depth FROM tg WHERE NOT tangled UNION ALL SELECT * FROM dp)
SELECT ms.conv AS conv_id, ms.turn, role, text, n_quotes, max_level, linked, reply_to, coalesce(depth, 0) AS depth, row_number() OVER (PARTITION BY ms.conv ORDER BY coalesce(depth, 0), ms.turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS position
FROM ms LEFT JOIN al ON al.conv IS NOT DISTINCT FROM ms.conv AND al.turn IS NOT DISTINCT FROM ms.turn
"""
