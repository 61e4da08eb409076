"""The lexical index as written tables with a manifest of counts and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeforge.functions import text as T
from citeforge.operators import evidence as E

KEYS = ["dataset_id", "split"]


def write_index(corpus: DataFrame, folder: str) -> DataFrame:
    """Write documents and postings below ``folder`` and return the manifest, which is written too.

    The manifest has a row for each dataset and split: counts, digests of the documents (in the
    order of their ids) and of the posting blocks (by token and block), and a digest of the two.
    """
    spark = corpus.sparkSession
    E.index_documents(corpus).write.parquet(f"{folder}/documents")
    documents = spark.read.parquet(f"{folder}/documents")
    numbered = corpus.join(documents.select(*KEYS, "source_doc_id", "internal_doc_id"), [*KEYS, "source_doc_id"])
    blocks = E.posting_blocks(E.postings(numbered, *KEYS, "internal_doc_id"), *KEYS)
    blocks.repartitionByRange("token").sortWithinPartitions("token", *KEYS, "block").write.parquet(f"{folder}/postings")
    postings = spark.read.parquet(f"{folder}/postings")
    entry = F.concat_ws(":", "source_doc_id", "text_hash", F.col("token_count").cast("string"))
    by_document = E.digest_tree(documents, "internal_doc_id", entry, *KEYS).withColumnRenamed("corpus_hash", "documents_hash")
    listed = F.array_join(F.transform("postings", lambda p: F.concat_ws(":", p["internal_doc_id"].cast("string"), p["term_frequency"].cast("string"))), ",")
    value = F.concat_ws("|", "token", F.col("block").cast("string"), listed)
    by_posting = E.ordered_digest(postings.withColumn("_order", F.struct("token", "block")), "_order", value, *KEYS).withColumnRenamed("corpus_hash", "postings_hash")
    counts = documents.groupBy(*KEYS).agg(F.count("*").alias("document_count"), F.sum("token_count").alias("token_count"))
    tokens = postings.groupBy(*KEYS).agg(F.count_distinct("token").alias("distinct_tokens"))
    manifest = counts.join(by_document, KEYS).join(tokens, KEYS, "left").join(by_posting, KEYS, "left").fillna(0, ["distinct_tokens"])
    whole = T.sha256(F.concat_ws(":", "documents_hash", F.coalesce("postings_hash", F.lit(""))))
    manifest.withColumn("index_hash", whole).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")
