"""Corpus to ledger, index and ranked evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeforge.functions import text as T
from citeforge.operators.judging import settled, with_group_ordinal
from citeforge.operators.sizing import small


def ledger_documents(docs: DataFrame) -> DataFrame:
    """Documents with normalised text, its hash and an id of their own.

    ``docs`` has source_doc_id, source_uri and text.
    """
    body = T.normalize(F.coalesce("text", F.lit("")))
    rows = docs.withColumn("text", body).withColumn("source_hash", T.sha256(F.col("text")))
    return rows.withColumn("document_id", F.concat(F.lit("doc_"), T.short_hash(F.concat("source_doc_id", "source_hash"))))


def ledger_spans(documents: DataFrame) -> DataFrame:
    """One row for each sentence, with the ids under which it can be replayed."""
    chunk = F.concat(F.lit("chunk_"), T.short_hash(F.concat("document_id", F.lit(":0"))))
    rows = documents.withColumn("chunk_id", chunk).select("document_id", "chunk_id", "source_doc_id", "source_uri", "source_hash", F.posexplode(T.sentences(F.col("text"))).alias("span_index", "span_text"))
    rows = rows.withColumn("span_hash", T.sha256(F.col("span_text")))
    ident = F.concat(F.lit("span_"), T.short_hash(F.concat_ws(":", "chunk_id", F.col("span_index").cast("string"), "span_hash")))
    return rows.withColumn("span_id", ident).withColumn("replay_path", F.concat("source_uri", F.lit("#span="), F.col("span_index").cast("string")))


def index_documents(corpus: DataFrame) -> DataFrame:
    """Documents of the index: dense ids by source_doc_id in each dataset and split, token counts.

    Texts are hashed and counted where they are read; they are not shuffled.
    """
    rows = corpus.select(
        "dataset_id",
        "split",
        "source_doc_id",
        T.sha256(F.coalesce("text", F.lit(""))).alias("text_hash"),
        F.size(T.tokens(F.coalesce("text", F.lit("")))).cast("long").alias("token_count"),
    )
    numbered = with_group_ordinal(rows, ["dataset_id", "split"], ["source_doc_id"], "_n")
    ident = (F.col("_n") - 1).cast("long").alias("internal_doc_id")
    return numbered.select("dataset_id", "split", "source_doc_id", ident, "text_hash", "token_count")


def postings(corpus: DataFrame, *keys: str) -> DataFrame:
    """(keys..., token, term_frequency): one row for each document and distinct token."""
    exploded = corpus.select(*keys, F.explode(T.tokens(F.col("text"))).alias("token"))
    return exploded.groupBy(*keys, "token").agg(F.count("*").alias("term_frequency"))


def term_stats(posted: DataFrame, *keys: str) -> DataFrame:
    """Document frequency and total frequency of each token."""
    return posted.groupBy(*keys, "token").agg(F.count("*").alias("document_frequency"), F.sum("term_frequency").alias("total_term_frequency"))


def posting_blocks(posted: DataFrame, *keys: str, block: int = 1024) -> DataFrame:
    """Posting lists in blocks of ``block`` internal ids, so that no list grows without bound."""
    rows = posted.withColumn("block", F.floor(F.col("internal_doc_id") / block))
    entry = F.struct("internal_doc_id", "term_frequency")
    return rows.groupBy(*keys, "token", "block").agg(F.sort_array(F.collect_list(entry)).alias("postings"))


def ordered_digest(rows: DataFrame, order: str, value: Column, *keys: str) -> DataFrame:
    """``digest_tree`` of rows by ``order``; digests alone are shuffled to number the leaves."""
    leaves = rows.select(*keys, F.col(order).alias("_order"), T.sha256(value).alias("_leaf"))
    numbered = with_group_ordinal(leaves, list(keys), ["_order"], "_n").withColumn("_n", F.col("_n") - 1)
    return digest_tree(numbered, "_n", None, *keys, digest="_leaf")


def digest_tree(rows: DataFrame, order: str, value: Column | None, *keys: str, digest: str | None = None, width: int = 1024) -> DataFrame:
    """Order-sensitive digest of each group of rows as a hash tree of ``width`` leaves a node.

    Leaves are numbered from 0 by ``order``, and ``digest`` names their hashes where these are there
    already; a level hashes the joined digests of its children. There are at least three levels, and
    as many more as the largest group needs to come down to one node. No task ever holds more than
    ``width`` digests of a group.
    """
    level = rows.select(*keys, F.col(order).alias("_at"), (F.col(digest) if digest else T.sha256(value)).alias("_digest"))
    last = level.agg(F.max("_at")).first()[0] or 0
    levels = 3
    while width**levels <= last:
        levels += 1
    for _ in range(levels):
        child = F.struct("_at", "_digest")
        grouped = level.groupBy(*keys, F.floor(F.col("_at") / width).alias("_up")).agg(F.sort_array(F.collect_list(child)).alias("_children"))
        level = grouped.select(*keys, F.col("_up").alias("_at"), T.sha256(F.array_join("_children._digest", "\n")).alias("_digest"))
    return level.select(*keys, F.col("_digest").alias("corpus_hash"))


def query_terms(questions: DataFrame, stopwords: list[str] | None = None) -> DataFrame:
    """(question_id, token, query_frequency)."""
    exploded = questions.select("question_id", F.explode(T.tokens(F.col("question_text"), stopwords)).alias("token"))
    return exploded.groupBy("question_id", "token").agg(F.count("*").alias("query_frequency"))


def asked_postings(corpus: DataFrame, terms: DataFrame, key: str, stopwords: list[str] | None = None, *kept: str) -> DataFrame:
    """``postings`` of the tokens in ``terms`` alone, dealt by ``key``.

    Tokens that nobody asks for go before the only shuffle. All that follows by ``key`` and further
    columns finds its rows in place.
    """
    exploded = corpus.select(key, *kept, F.explode(T.tokens(F.col("text"), stopwords)).alias("token"))
    asked = exploded.join(small(settled(terms.select("token").distinct())), "token", "left_semi")
    return asked.repartition(key).groupBy(key, *kept, "token").agg(F.count("*").alias("term_frequency"))


def _scores(questions: DataFrame, corpus: DataFrame, key: str) -> DataFrame:
    """Summed term frequencies by question and document.

    The sums are made where the document's tokens are; of a question's documents only the best of
    each partition leave it, once a rank is asked for.
    """
    terms = settled(query_terms(questions))
    met = asked_postings(corpus, terms, key).join(small(terms), "token")
    return met.groupBy("question_id", key).agg(F.sum(F.col("query_frequency") * F.col("term_frequency")).alias("score"))


def rank_evidence(questions: DataFrame, corpus: DataFrame, top_k: int = 8) -> DataFrame:
    """The documents of greatest summed term frequency for each question; ties by source_doc_id."""
    scores = _scores(questions, corpus, "source_doc_id")
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "source_doc_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def rank_scoped(questions: DataFrame, corpus: DataFrame, context: DataFrame, top_k: int = 8) -> DataFrame:
    """As ``rank_evidence`` among each question's own context (question_id, source_doc_id).

    Context documents that match nothing fill up with score 0. A question without a context is
    ranked among all documents.
    """
    scores = _scores(questions, corpus.join(context.select("source_doc_id").distinct(), "source_doc_id", "left_semi"), "source_doc_id")
    rows = context.join(scores, ["question_id", "source_doc_id"], "left").withColumn("score", F.coalesce("score", F.lit(0)))
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "source_doc_id")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    free = settled(questions.join(context.select("question_id").distinct(), "question_id", "left_anti"))
    return ranked if free.isEmpty() else ranked.unionByName(rank_evidence(free, corpus, top_k))


def process_contexts(records: DataFrame) -> DataFrame:
    """Corpus rows of question-answering records with a context of (title, sentences) entries.

    ``records`` has question_id, source_uri and context array<struct<title, sentences>>.
    """
    entries = records.select("question_id", "source_uri", F.posexplode("context").alias("context_index", "c"))
    return context_rows(entries.select("question_id", "source_uri", "context_index", "c.title", "c.sentences"))


def context_rows(entries: DataFrame) -> DataFrame:
    """Corpus rows of entries (question_id, source_uri, context_index, title, sentences)."""
    place = F.col("context_index").cast("string")
    doc = F.concat_ws("_", T.id_part(F.col("question_id")), F.lit("doc"), place, T.slug(F.col("title")))
    body = F.filter(F.transform("sentences", lambda s: T.normalize(s)), lambda s: s != "")
    uri = F.concat("source_uri", F.lit("#question="), "question_id", F.lit("&context="), place)
    rows = entries.select("question_id", "context_index", "title", doc.alias("source_doc_id"), F.concat_ws(" ", body).alias("text"), uri.alias("source_uri"))
    return rows.withColumn("source_hash", T.sha256(F.col("text")))


def support_references(facts: DataFrame, corpus: DataFrame) -> DataFrame:
    """Supporting facts (question_id, title, sentence_index) with their document.

    Of equal titles in a question the last context wins; a fact without a document keeps null.
    """
    title = T.normalize(F.col("title"))
    last = corpus.groupBy("question_id", title.alias("title_key")).agg(F.max_by("source_doc_id", "context_index").alias("source_doc_id"))
    rows = facts.withColumn("title_key", title).join(last, ["question_id", "title_key"], "left")
    ident = F.when(F.col("source_doc_id").isNotNull(), F.concat("source_doc_id", F.lit("_sent_"), F.col("sentence_index").cast("string")))
    return rows.withColumn("sentence_id", ident).drop("title_key")


def paragraph_rows(paragraphs: DataFrame) -> DataFrame:
    """Corpus rows of question paragraphs, which name their place and text in several ways.

    ``paragraphs`` has question_id, source_uri, position (from 0), idx, paragraph_idx, title,
    paragraph_text, text, paragraph and is_supporting, any of them null.
    """
    idx = F.coalesce("idx", "paragraph_idx", "position").cast("long")
    title = T.normalize(F.coalesce(T.truthy(F.col("title")), F.concat(F.lit("paragraph_"), idx.cast("string"))))
    body = T.normalize(T.first_of(F.col("paragraph_text"), F.col("text"), F.col("paragraph")))
    rows = paragraphs.select("question_id", "source_uri", "position", idx.alias("paragraph_idx"), title.alias("title"), body.alias("text"), F.coalesce("is_supporting", F.lit(False)).alias("is_supporting"))
    doc = F.concat_ws("_", F.lit("musique"), T.slug(F.col("question_id")), F.lit("para"), F.col("paragraph_idx").cast("string"), T.slug(F.col("title")))
    uri = F.concat("source_uri", F.lit("#question="), "question_id", F.lit("&paragraph="), F.col("paragraph_idx").cast("string"))
    return rows.withColumns({"source_doc_id": doc, "source_uri": uri, "source_hash": T.sha256(F.col("text"))})


def paragraph_support(paragraphs: DataFrame, corpus: DataFrame) -> DataFrame:
    """Supporting paragraphs with their document; a paragraph without a place counts as number 0 here,
    and of equal numbers in a question the last paragraph is meant.

    ``corpus`` comes from ``paragraph_rows``.
    """
    asked = paragraphs.where(F.coalesce("is_supporting", F.lit(False)))
    asked = asked.select("question_id", "position", F.coalesce("idx", "paragraph_idx", F.lit(0)).cast("long").alias("paragraph_idx"))
    last = corpus.groupBy("question_id", "paragraph_idx").agg(F.max_by(F.struct("source_doc_id", "title"), "position").alias("_d"))
    return asked.join(last, ["question_id", "paragraph_idx"], "left").select("question_id", "position", "paragraph_idx", "_d.source_doc_id", "_d.title")
