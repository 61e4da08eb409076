"""Benchmark decontamination by size-partitioned MinHash containment search.

Short test items are found inside long documents, with DataFrame functions alone. Items are
partitioned by size (powers of two of their shingles); each keeps the smallest hashes of its
shingles as its sketch. A document holds an item by ``CONTAINED`` percent only if at most
``missing`` of the item's shingles lack in it, so a sketch of ``missing + extra`` hashes must be hit
``extra`` times or more: no such item is lost. The sketches, whose size follows the benchmark's, are
broadcast up to a checked bound, and document shingles stream past them without a shuffle. The few
candidates are then verified on exact shingles of the whole texts.

A shingle is five lower-case words; a text of one to four words is one shingle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeforge.llm import shared

WIDTH = 5
CONTAINED = 75  # percent
_BLANKS = "[\\x09-\\x0D\\x20]+"


def words_of(text: Column) -> Column:
    """Lower-case words; an empty array for a null text."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _BLANKS), "")


def _padded(words: Column) -> Column:
    """Texts of one to four words are filled up to five, so that they make one shingle."""
    n = F.size(words)
    return F.when((n > 0) & (n < WIDTH), F.slice(F.concat(words, F.array(*[F.lit("")] * (WIDTH - 1))), 1, WIDTH)).otherwise(words)


def _tuples(words: Column) -> Column:
    """The shingles of padded words as structs of five words."""
    n = F.greatest(F.size(words) - (WIDTH - 1), F.lit(0))
    return F.arrays_zip(*[F.slice(words, k + 1, n).alias(f"w{k}") for k in range(WIDTH)])


def _strings(words: Column) -> Column:
    """The distinct shingles of padded words as strings."""
    return F.array_distinct(F.transform(_tuples(words), lambda s: F.concat_ws(" ", *[s[f"w{k}"] for k in range(WIDTH)])))


def _items(benchmark: DataFrame) -> DataFrame:
    """Distinct items with their exact shingles; items without a word are left out."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    rows = rows.withColumn("item", F.xxhash64("item_id", "text")).withColumn("words", _padded(words_of(F.col("text"))))
    rows = rows.select("item", "item_id", _strings(F.col("words")).alias("shingles"), _tuples(F.col("words")).alias("tuples"))
    return rows.where(F.size("shingles") > 0)


def _hash(shingle: Column) -> Column:
    return F.xxhash64(*[shingle[f"w{k}"] for k in range(WIDTH)])


def _sketches(items: DataFrame) -> DataFrame:
    """(hash, item, needed): the smallest hashes of each item, as many as its size class asks for."""
    n = F.size("shingles")
    upper = F.pow(F.lit(2.0), F.floor(F.log2(n)) + 1) - 1  # the largest size of the item's class
    asked = F.floor(upper * (100 - CONTAINED) / 100) + 1 + F.floor(upper / 8)
    missing = F.floor(n * F.lit(100 - CONTAINED) / 100)
    rows = items.select("item", F.least(asked, n).cast("long").alias("asked"), missing.cast("long").alias("missing"), F.explode("tuples").alias("s"))
    rows = rows.select("item", "asked", "missing", _hash(F.col("s")).alias("hash")).distinct()
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy("hash")))
    return ranked.where("rank <= asked").select("hash", "item", (F.col("asked") - F.col("missing")).alias("needed"))


def contained_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_key, item_id, n_item_shingles, n_shared) for each document that holds an item.

    ``text_key`` is the hash of the document's text, so rows of equal id and different text stay
    apart, and repeated rows are one. Null and blank texts hold nothing and are held by nothing; a
    null id is kept as null. Very long texts stream past the sketches and are verified whole. Other
    columns are not read. An empty table on either side gives an empty one.
    """
    items = shared.materialize(_items(benchmark), "benchmark-items")
    sketches = shared.small(shared.materialize(_sketches(items), "benchmark-sketches"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    words = rows.select("doc_id", "text_key", words_of(F.col("text")).alias("words"))
    shingles = words.select("doc_id", "text_key", F.explode(_tuples(_padded(F.col("words")))).alias("s")).select("doc_id", "text_key", _hash(F.col("s")).alias("hash"))
    hits = shingles.join(sketches, "hash").groupBy("doc_id", "text_key", "item").agg(F.count_distinct("hash").alias("hits"), F.first("needed").alias("needed"))
    found = shared.materialize(hits.where("hits >= needed").select("doc_id", "text_key", "item"), "candidates")
    pairs = found.select("text_key", "item").distinct()
    texts = rows.select("text_key", "text").join(shared.small(found.select("text_key")), "text_key", "left_semi")
    texts = texts.groupBy("text_key").agg(F.first("text").alias("text"))
    held = texts.select("text_key", _strings(_padded(words_of(F.col("text")))).alias("held"))
    met = pairs.join(held, "text_key").join(shared.small(items.select("item", "item_id", "shingles")), "item")
    met = met.select("text_key", "item", "item_id", F.size("shingles").cast("long").alias("n_item_shingles"), F.size(F.array_intersect("held", "shingles")).cast("long").alias("n_shared"))
    sure = shared.materialize(met.where(100 * F.col("n_shared") >= CONTAINED * F.col("n_item_shingles")), "contained")
    return found.join(sure, ["text_key", "item"]).select("doc_id", "text_key", "item_id", "n_item_shingles", "n_shared")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns as they are, whatever their names.

    Null, empty and blank texts hold nothing and stay; equal texts have one fate. Without items all
    rows stay.
    """
    found = shared.materialize(contained_items(docs, benchmark).select(F.col("text_key").alias("key")).distinct(), "held")
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("key"))
    return rows.join(shared.small(found), "key", "left_anti").select("row.*")


def op6_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold a benchmark item."""
    found = contained_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    share = F.col("n_shared").cast("double") / F.col("n_item_shingles")
    return found.select("doc_id", "item_id", "n_item_shingles", "n_shared", share.alias("containment"))


#: DuckDB SQL for the same rows, by an exact join of all shingles.
ORACLE = r"""
WITH t AS (
  SELECT 0 AS kind, doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x09-\x0D\x20]+'), lambda x: x <> '') FROM benchmark
), s AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM t
), n AS (SELECT id AS item_id, count(*) AS n FROM s WHERE kind = 1 GROUP BY id),
m AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS shared FROM s d JOIN s b USING (g) WHERE d.kind = 0 AND b.kind = 1 GROUP BY d.id, b.id)
SELECT doc_id, item_id, n AS n_item_shingles, shared AS n_shared, CAST(shared AS DOUBLE) / n AS containment
FROM m JOIN n USING (item_id) WHERE 100 * shared >= 75 * n
"""
