"""The corpus pipeline: language, near copies, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but
the last return the columns of ``docs`` as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeforge.llm import bytecnn, containment, markov, oddsketch, packing, shared

#: Documents whose language the network gives less probability than this are rejected.
LEAST_SCORE = 0.5


def _names(docs: DataFrame) -> list[str]:
    """Names that no stage uses, for all columns but the two that stages read."""
    return [c if c in ("doc_id", "text") else f"kept_{i}" for i, c in enumerate(docs.columns)]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter (null and empty texts too), and those whose language is not
    clear. Repeated rows and null ids have one fate by their text; an empty table stays empty."""
    names = _names(docs)
    network = bytecnn.train(docs.select("doc_id", "text", "lang"))
    known = bytecnn.identify(docs.toDF(*names), network)
    clear = known.where((F.col("lang_pred") != bytecnn.UNKNOWN) & (F.col("lang_score") >= LEAST_SCORE))
    return clear.select(names).toDF(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group of near copies; of repeated rows one stays.

    Texts without a word, and rows without an id, stay.
    """
    return oddsketch.one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item; null and empty texts hold none."""
    return containment.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mark; n_chars follows the text where it changes. Null texts stay null,
    and all rows stay, repeated ones included."""
    names = _names(docs)
    found = markov.find_secrets(docs.toDF(*names)).withColumn("clean", markov.redacted(F.col("text"), F.col("all_spans")))
    changed = F.size("all_spans") > 0

    def column(c: str, name: str):
        if c == "text":
            return F.col("clean")
        return F.when(changed, F.length("clean").cast("long")).otherwise(F.col(name)) if c == "n_chars" else F.col(name)

    return found.select([column(c, n).alias(c) for c, n in zip(docs.columns, names, strict=True)])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id pieces in sequences of at most 4096; a null or empty text is one end token."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", language),
    ("near copies", near_copies),
    ("benchmark leaks", benchmark_leaks),
    ("secrets", secrets),
    ("packing", packing_stage),
]

#: A trained network decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage keeps is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
