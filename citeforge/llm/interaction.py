"""Filter interaction audit: what each filter removes in every order of the filters.

Five filters are judged once for each document, as bits of a mask. Documents are counted by part
and mask, so all orders are worked out on at most 32 cells a part. A recursive query extends filter
prefixes by unused letters: each level takes the cells of the one before, with the bits of the
filters applied so far, and gives what the new filter does to each cell.

Rows: a null text is empty, a null source is the part ''. An empty text fails A alone (and E where a
smaller doc_id's text is empty too). Rows of one doc_id are documents of their own; with equal texts
they do not fail E for each other, since neither id is smaller. A null doc_id is smaller than none
and none is smaller than it, and it has no label. Several labels of a doc_id count as one: good or
toxic where any of them is. Very long texts are judged whole, where they are read. An empty table
has no parts and gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeforge.llm import shared

LETTERS = "ABCDE"
_BLANKS = "[ \\t-\\r]+"


def with_mask(rows: DataFrame) -> DataFrame:
    """Add ``mask``, the bits of filters A to D: too short, repetitive, too many capitals, odd marks.

    Counts are columns of their own, so that a text is split once.
    """
    words = F.array_remove(F.split("text", _BLANKS), "")
    counted = rows.withColumn("_words", words)
    counted = counted.withColumns({"_n": F.size("_words").cast("long"), "_distinct": F.size(F.array_distinct("_words")).cast("long"), "_capitals": F.regexp_count("text", F.lit("[A-Z]")).cast("long")})
    n, distinct, capitals = F.col("_n"), F.col("_distinct"), F.col("_capitals")
    fails = [n < 200, 100 * distinct < 50 * n, 100 * capitals > 2 * F.length("text").cast("long"), F.col("text").rlike("[#$%&*|]")]
    return counted.withColumn("mask", sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))).drop("_words", "_n", "_distinct", "_capitals")


def document_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic): one row for each document, with the bits of all five filters.

    Texts are judged and hashed where they are read. Of a text's copies the smallest doc_id is found
    by a pre-aggregated minimum, and its document by a join on text and doc_id together, which no
    group of copies can overload.
    """
    # Texts are told apart by two independent hashes of 64 bits and the length.
    key = [F.xxhash64("text").alias("h1"), F.substring(F.sha2("text", 256), 1, 16).alias("h2"), F.length("text").alias("h3")]
    texts = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    judged = shared.materialize(with_mask(texts).select("doc_id", "part", "mask", *key), "judged")
    first = judged.where("doc_id is not null").groupBy("h1", "h2", "h3").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = known.select("doc_id", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).where("good > 0 or toxic > 0")
    named = judged.where("doc_id is not null").join(first, ["h1", "h2", "h3", "doc_id"], "left").join(known, "doc_id", "left")
    copy = F.when(F.col("is_first").isNull(), 1 << 4).otherwise(0)
    rows = named.select("part", (F.col("mask") + copy).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    return rows.unionByName(judged.where("doc_id is null").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic")))


def mask_cells(masks: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): the counts of each mask in each part."""
    return masks.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic"))


# Each level extends every prefix by its unused letters. A row is a prefix and a mask that occurs:
# ``applied`` has the bits of the prefix, ``bit`` the new filter's, and the states of the mask under
# them are what the level emits. There are 325 prefixes and 32 masks at most, whatever the data.
_LEVELS = """
WITH RECURSIVE walk(step, prefix, letter, bit, applied, mask, kept, removed, redundant, unique_fails) AS (
  SELECT 0, '', '', 0, 0, mask, 1, 0, 0, 0 FROM {masks}
  UNION ALL
  SELECT step + 1, concat(prefix, f.letter), f.letter, f.bit, applied | f.bit, w.mask,
    if(w.mask & (applied | f.bit) = 0, 1, 0),
    if(w.mask & f.bit <> 0 AND w.mask & applied = 0, 1, 0),
    if(w.mask & f.bit <> 0 AND w.mask & applied <> 0, 1, 0),
    if(w.mask = f.bit, 1, 0)
  FROM (SELECT w.step, w.prefix, w.applied, c.mask, explode({filters}) AS f FROM walk w JOIN {masks} c ON c.mask = w.mask WHERE w.step < {n}) w
  WHERE applied & f.bit = 0
)
SELECT step, prefix, letter, mask, kept, removed, redundant, unique_fails FROM walk WHERE step > 0
"""


def walk_prefixes(spark: SparkSession, masks: DataFrame, letters: str = LETTERS) -> DataFrame:
    """What each prefix's last filter does to each mask: (step, prefix, letter, mask, kept, removed, redundant, unique_fails)."""
    filters = "array(" + ", ".join(f"named_struct('letter', '{x}', 'bit', {1 << k})" for k, x in enumerate(letters)) + ")"
    sql = _LEVELS.replace("{filters}", filters).replace("{n}", str(len(letters)))
    return spark.sql(sql, masks=masks)


def audit_orders(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row for each part, order of all filters and step, from ``mask_cells``.

    Spark allows no aggregate over the recursive reference, so levels emit states of masks, and the
    documents in them are summed here; orders share the prefixes that they begin with.
    """
    spark = cells.sparkSession
    cells = shared.materialize(cells, "cells")
    states = shared.materialize(walk_prefixes(spark, shared.materialize(cells.select("mask").distinct(), "masks"), letters), "states")
    met = cells.join(F.broadcast(states), "mask")  # at most 325 prefixes x 32 masks
    n = lambda c, v="n": F.sum(F.col(c) * F.col(v)).alias
    steps = met.groupBy("part", "step", "prefix", "letter").agg(
        n("kept")("kept"), n("removed")("removed"), n("redundant")("redundant"), n("unique_fails")("unique_fails"), n("removed", "good")("good_lost"), n("removed", "toxic")("toxic_lost")
    )
    steps = shared.materialize(steps, "steps")
    # A prefix of k letters begins (5 - k)! orders, and each of these has its step k.
    orders = states.where(F.col("step") == len(letters)).select(F.col("prefix").alias("filter_order")).distinct()
    begins = orders.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step")).withColumn("prefix", F.expr("substr(filter_order, 1, step)"))
    table = steps.join(F.broadcast(begins), ["step", "prefix"])  # 120 orders x 5 steps
    shares = table.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    out = table.join(shares, ["part", "letter"])
    counts = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return out.select("part", "filter_order", F.col("step").cast("int").alias("step"), *[F.col(c).cast("long").alias(c) for c in counts])


def op11_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents in all 120 orders."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit_orders(mask_cells(document_masks(docs, labels)))


ORACLE = """WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[ \\t-\\r]+'), lambda x: x <> '') AS ws FROM d),
m AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT w.part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 2 * length(w.text), regexp_matches(w.text, '[#$%&*|]'), coalesce(w.doc_id > first, false)] AS fails,
  coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w JOIN m USING (text) LEFT JOIN l ON l.doc_id = w.doc_id),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest(range(1, 6)) AS k),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.k, b.k, c.k, d.k, e.k] AS ks FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT filter_order, unnest(ks) AS k, unnest(range(1, 6)) AS step, ks FROM o),
g AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
j AS (SELECT part, filter_order, step, k, n, good, toxic, fails[k] AS hit, len(list_filter(ks[1:step - 1], lambda q: fails[q])) > 0 AS gone, len(list_filter(fails, lambda q: q)) = 1 AS alone FROM g, s),
r AS (SELECT part, filter_order, step, k, sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END) AS removed, sum(CASE WHEN gone AND hit THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN hit AND alone THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN NOT gone AND hit AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND hit AND toxic THEN n ELSE 0 END) AS toxic_lost FROM j GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley FROM r"""
