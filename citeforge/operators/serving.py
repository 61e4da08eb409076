"""Exact top-k over posting blocks, with what cannot be among the k left unscored.

Documents are numbered by their id, so a number decides ties. A block has the postings of a token in
128 consecutive documents and the greatest term frequency among them. Blocks are written in
buckets of tokens: a search lists the buckets that its questions need, and the others are not read.

A search deals blocks, not scores: all asked blocks of the same documents come to one task, rarest
token first. For each question the task holds the k best scores so far, from a start that the term
statistics give: k documents score at least what their k-th greatest frequency of one term gives. A
block of documents whose greatest possible score is below the k-th one is skipped; in the others,
documents that hold only such frequent tokens as cannot reach it together are not scored.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeforge.functions import text as T
from citeforge.operators import evidence as E
from citeforge.operators.judging import settled, with_ordinal
from citeforge.operators.sizing import small

BLOCK = 128  # small, so that few blocks hold one of the long documents that raise a bound
BUCKETS = 64
CHUNK = 32768  # blocks of a bucket that one task writes
MAX_K = 64  # ranks up to which term statistics are kept
QUESTIONS = 512  # about so many are searched together in a task

_SCORED = "doc long, score double, blocks long, skipped long, pairs long"


def bucket_of(token: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


# Blocks, term statistics and lengths


def numbered_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key, doc): the distinct keys numbered from 0 in their order."""
    return with_ordinal(rows.select(key).distinct(), [key], "_ordinal").select(key, (F.col("_ordinal") - 1).cast("long").alias("doc"))


def posting_blocks(posted: DataFrame, ids: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, block, token, max_tf, docs, tfs) of postings (key, token, term_frequency).

    Rows of one token are dealt by chunks of blocks, so a frequent token is not one task's.
    """
    rows = posted.join(small(ids), key).select(
        bucket_of(F.col("token"), buckets).alias("bucket"), F.expr(f"doc div {BLOCK}").alias("block"), F.expr(f"doc div {BLOCK * CHUNK}").alias("chunk"), "token", F.struct((F.col("doc") % BLOCK).cast("int").alias("at"), F.col("term_frequency").cast("int").alias("tf")).alias("p")
    )
    listed = rows.repartition("bucket", "chunk").groupBy("bucket", "chunk", "block", "token").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return listed.select("bucket", "block", "token", F.array_max("p.tf").alias("max_tf"), F.col("p.at").alias("docs"), F.col("p.tf").alias("tfs"))


def term_statistics(blocks: DataFrame) -> DataFrame:
    """(bucket, token, document_frequency, best): ``best`` lists the greatest term frequencies with the
    number of documents that have them or more, up to ``MAX_K`` documents.

    Frequencies are counted before they are ordered, so a token has a row for each distinct one.
    """
    counted = blocks.select("bucket", "token", F.explode("tfs").alias("tf")).groupBy("bucket", "token", "tf").agg(F.count("*").alias("n"))
    falling = Window.partitionBy("bucket", "token").orderBy(F.desc("tf"))
    rows = counted.withColumn("upto", F.sum("n").over(falling))
    entry = F.when(F.col("upto") - F.col("n") < MAX_K, F.struct("upto", "tf"))
    return rows.groupBy("bucket", "token").agg(F.sum("n").alias("document_frequency"), F.sort_array(F.collect_list(entry)).alias("best"))


def block_lengths(lengths: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """(block, docs, tfs): the lengths (key, n) of the documents of each block."""
    rows = lengths.join(small(ids), key).select(F.expr(f"doc div {BLOCK}").alias("block"), F.struct((F.col("doc") % BLOCK).cast("int").alias("at"), F.col("n").cast("int").alias("tf")).alias("p"))
    listed = rows.groupBy("block").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return listed.select("block", F.col("p.at").alias("docs"), F.col("p.tf").alias("tfs"))


def write_serving_index(corpus: DataFrame, folder: str, key: str = "source_doc_id", buckets: int = BUCKETS) -> None:
    """Write ``keys``, ``postings`` and ``terms`` below ``folder``; the last two in buckets of tokens."""
    spark = corpus.sparkSession
    numbered_keys(corpus, key).write.parquet(f"{folder}/keys")
    ids = spark.read.parquet(f"{folder}/keys")
    blocks = posting_blocks(E.postings(corpus, key), ids, key, buckets)
    blocks.sortWithinPartitions("bucket", "token", "block").write.partitionBy("bucket").parquet(f"{folder}/postings")
    written = spark.read.parquet(f"{folder}/postings")
    term_statistics(written).repartition("bucket").sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{folder}/terms")


def asked_buckets(spark: SparkSession, folder: str, table: str, terms: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """A written table's rows in the buckets of ``terms``; their list, at most all buckets, prunes the scan."""
    found = [r[0] for r in terms.select(bucket_of(F.col("token"), buckets).alias("b")).distinct().collect()]
    return spark.read.parquet(f"{folder}/{table}").where(F.col("bucket").isin(found))


# Scores


@dataclass(frozen=True)
class FrequencyScore:
    """Sum of query frequency times term frequency."""

    def gain(self, qf, tf):
        return qf * tf

    def bound(self, gain, least_length, terms):
        return gain

    def final(self, gain, lengths, terms):
        return gain.astype(float)


@dataclass(frozen=True)
class OverlapScore:
    """Multiset overlap, over the question's distinct terms and over the square root of the length,
    rounded half to even to six places."""

    def gain(self, qf, tf):
        return np.minimum(qf, tf)

    def bound(self, gain, least_length, terms):
        # A document is at least as long as what it shares; a millionth allows for rounding.
        return gain / np.maximum(terms, 1) + gain / np.sqrt(np.maximum(np.maximum(gain, least_length), 1)) + 1e-6

    def final(self, gain, lengths, terms):
        exact = gain / terms + gain / np.sqrt(lengths)
        six = decimal.Decimal("0.000001")
        rounded = {x: float(decimal.Decimal(repr(x)).quantize(six, decimal.ROUND_HALF_EVEN)) for x in set(exact.tolist())}
        return np.array([rounded[x] for x in exact.tolist()])


class _Search:
    """What a task knows of its questions while blocks pass."""

    def __init__(self, score, top_k: int):
        self.score, self.top_k = score, top_k
        self.slots: dict = {}
        self.terms, self.least = np.zeros(0), np.zeros(0)
        self.best: list[tuple[np.ndarray, np.ndarray]] = []
        self.blocks = self.skipped = self.pairs = 0

    def slot(self, question, terms: int, least: float) -> int:
        if question not in self.slots:
            self.slots[question] = len(self.slots)
            self.terms, self.least = np.append(self.terms, terms), np.append(self.least, least)
            self.best.append((np.zeros(0), np.zeros(0, np.int64)))
        return self.slots[question]

    def block(self, number: int, rows: list, lengths: np.ndarray | None) -> None:
        """Score the documents of a block; ``rows`` are (max_tf, docs, tfs, slots, qf), rarest token first."""
        n = len(self.slots)
        gains = [(slots, self.score.gain(qf, top)) for top, _, _, slots, qf in rows]
        rest = np.zeros(n)
        for slots, g in gains:
            rest[slots] += g
        shortest = float(lengths[lengths > 0].min(initial=BLOCK << 20)) if lengths is not None else 0.0
        asked = rest > 0
        alive = asked & (self.score.bound(rest, shortest, self.terms) >= self.least)
        self.blocks += int(asked.sum())
        self.skipped += int((asked & ~alive).sum())
        if not alive.any():
            return
        row_of = np.cumsum(alive) - 1
        total = np.zeros((int(alive.sum()), BLOCK))
        for (slots, g), (_, docs, tfs, _, qf) in zip(gains, rows, strict=True):
            on = alive[slots]
            if on.any():
                s, q = slots[on], qf[on][:, None]
                first = self.score.bound(rest[s], shortest, self.terms[s]) >= self.least[s]
                for chosen, fresh in ((first, True), (~first, False)):
                    if chosen.any():
                        cells = np.ix_(row_of[s[chosen]], docs)
                        more = self.score.gain(q[chosen], tfs[None, :])
                        total[cells] += more if fresh else more * (total[cells] > 0)
            rest[slots] -= g
        for slot in np.flatnonzero(alive):
            got = total[row_of[slot]]
            docs = np.flatnonzero(got)
            self.pairs += len(docs)
            worth = self.score.bound(got[docs], lengths[docs] if lengths is not None else 0, self.terms[slot]) >= self.least[slot]
            docs = docs[worth]
            if len(docs):
                self._keep(slot, self.score.final(got[docs], lengths[docs] if lengths is not None else None, self.terms[slot]), docs + number * BLOCK)

    def _keep(self, slot: int, scores: np.ndarray, docs: np.ndarray) -> None:
        s, d = np.concatenate([self.best[slot][0], scores]), np.concatenate([self.best[slot][1], docs])
        order = np.lexsort((d, -s))[: self.top_k]
        self.best[slot] = s[order], d[order]
        if len(order) == self.top_k:
            self.least[slot] = max(self.least[slot], s[order[-1]])


def _scan(score, top_k: int, question_type: pa.DataType):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, state = [], None
        place, rows, lengths = None, [], None

        def close() -> None:
            if rows:
                state.block(place[1], rows, lengths)

        def finish() -> None:
            close()
            if state:
                found.append(state)

        for batch in batches:
            col = {n: batch.column(n) for n in batch.schema.names}
            asked = col["asked"].values
            ask_at, doc_at = col["asked"].offsets.to_numpy(), col["docs"].offsets.to_numpy()
            docs, tfs = col["docs"].values.to_numpy(), col["tfs"].values.to_numpy()
            questions, qf = asked.field("question_id").to_pylist(), asked.field("qf").to_numpy().astype(float)
            terms, least = asked.field("terms").to_pylist(), asked.field("least").to_pylist()
            groups, blocks, tops = col["grp"].to_pylist(), col["block"].to_pylist(), col["max_tf"].to_pylist()
            for i in range(batch.num_rows):
                if (groups[i], blocks[i]) != place:
                    close()
                    if place is None or groups[i] != place[0]:
                        if state:
                            found.append(state)
                        state = _Search(score, top_k)
                    place, rows, lengths = (groups[i], blocks[i]), [], None
                span = slice(doc_at[i], doc_at[i + 1])
                if tops[i] is None:  # the lengths of the block's documents
                    lengths = np.zeros(BLOCK)
                    lengths[docs[span]] = tfs[span]
                    continue
                some = range(ask_at[i], ask_at[i + 1])
                slots = np.array([state.slot(questions[j], terms[j], least[j]) for j in some], np.int64)
                rows.append((tops[i], docs[span], tfs[span].astype(float), slots, qf[ask_at[i] : ask_at[i + 1]]))
        finish()
        out = [[], [], [], [], [], []]
        for s in found:
            for question, slot in s.slots.items():
                for value, doc in zip(*(x.tolist() for x in s.best[slot]), strict=True):
                    for c, v in zip(out, (question, doc, value, None, None, None), strict=True):
                        c.append(v)
            for c, v in zip(out, (None, None, None, s.blocks, s.skipped, s.pairs), strict=True):
                c.append(v)
        kinds = [question_type, pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["question_id", "doc", "score", "blocks", "skipped", "pairs"])

    return scan


def search(terms: DataFrame, blocks: DataFrame, statistics: DataFrame, top_k: int, score=None, lengths: DataFrame | None = None) -> DataFrame:
    """The best documents of each task for each question, and a row of counts for each task, written.

    ``terms`` has question_id, token and query_frequency; ``blocks`` and ``statistics`` at least the
    tokens in it. Rows with a question have doc and score; the others count the blocks that
    questions asked for, those that were skipped, and the pairs of question and document scored.
    """
    score = score or FrequencyScore()
    if top_k > MAX_K:
        raise ValueError(f"term statistics hold for {MAX_K} ranks")
    known = terms.join(small(settled(statistics.join(terms.select("token").distinct(), "token", "left_semi"))), "token")
    kth = F.element_at(F.filter("best", lambda x: x["upto"] >= top_k), 1)
    least = kth["tf"] * F.col("query_frequency") if isinstance(score, FrequencyScore) else F.lit(0)
    known = known.withColumn("_least", F.coalesce(F.when(F.col("document_frequency") >= top_k, least), F.lit(0)))
    facts = known.groupBy("question_id").agg(F.max("_least").cast("double").alias("least"))
    width = terms.groupBy("question_id").agg(F.count("*").alias("terms"))
    several = max(1, round(facts.count() / QUESTIONS))
    grouped = known.join(facts, "question_id").join(width, "question_id").withColumn("grp", F.pmod(F.xxhash64("question_id"), F.lit(several)))
    # About QUESTIONS questions at most ask for a token in a group.
    asked = grouped.groupBy("grp", "token", "document_frequency").agg(F.collect_list(F.struct("question_id", F.col("query_frequency").cast("long").alias("qf"), F.col("terms").cast("long").alias("terms"), "least")).alias("asked"))
    asked = settled(asked)
    met = blocks.join(small(asked), "token").select("grp", "block", "document_frequency", "token", "max_tf", "docs", "tfs", "asked")
    if lengths is not None:
        empty = F.array().cast(asked.schema["asked"].dataType)
        every = lengths.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(several - 1).cast("long"))).alias("grp"), "block", F.lit(-1).cast("long").alias("document_frequency"), F.lit("").alias("token"), F.lit(None).cast("int").alias("max_tf"), "docs", "tfs", empty.alias("asked"))
        met = met.unionByName(every)
    dealt = met.repartition("grp", "block").sortWithinPartitions("grp", "block", "document_frequency", "token")
    kind = terms.schema["question_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    return settled(dealt.mapInArrow(_scan(score, top_k, to_arrow_type(kind)), f"question_id {kind.simpleString()}, {_SCORED}"))


def ranked(found: DataFrame, ids: DataFrame, key: str, top_k: int) -> DataFrame:
    """(question_id, key, score, rank) of a search; at most ``top_k`` rows a question and task are compared."""
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "doc")
    best = found.where("question_id is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    best = settled(best.select("question_id", "doc", "score", "rank"))
    return ids.join(small(best), "doc").select("question_id", key, "score", "rank")


def counts(found: DataFrame) -> DataFrame:
    """One row: question-block pairs asked for and skipped, and question-document pairs scored."""
    return found.where("question_id is null").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("blocks", "skipped", "pairs")])


# Rankings


def rank_pruned(questions: DataFrame, folder: str, top_k: int = 8, key: str = "source_doc_id", buckets: int = BUCKETS) -> DataFrame:
    """``rank_evidence`` from a written index; only buckets of asked tokens are read."""
    spark = questions.sparkSession
    terms = settled(E.query_terms(questions))
    blocks, statistics = (asked_buckets(spark, folder, t, terms, buckets) for t in ("postings", "terms"))
    found = search(terms, blocks, statistics, top_k)
    return ranked(found, spark.read.parquet(f"{folder}/keys"), key, top_k)


def overlap_search(questions: DataFrame, spans: DataFrame, top_k: int = 2) -> tuple[DataFrame, DataFrame]:
    """(a search by multiset overlap, the numbered span ids); of spans only asked tokens are dealt."""
    terms = settled(E.query_terms(questions, T.RETRIEVAL_STOPWORDS))
    own = spans.select("span_id", T.tokens(F.col("text"), T.RETRIEVAL_STOPWORDS).alias("t"))
    ids = settled(numbered_keys(spans, "span_id"))
    asked = own.select("span_id", F.explode("t").alias("token")).join(small(settled(terms.select("token").distinct())), "token", "left_semi")
    posted = asked.groupBy("span_id", "token").agg(F.count("*").alias("term_frequency"))
    blocks = settled(posting_blocks(posted, ids, "span_id"))
    lengths = block_lengths(own.select("span_id", F.size("t").alias("n")), ids, "span_id")
    return search(terms, blocks, term_statistics(blocks), top_k, OverlapScore(), lengths), ids


def retrieve_spans(questions: DataFrame, spans: DataFrame, top_k: int = 2) -> DataFrame:
    """Multiset overlap with each span, weighted by coverage of the question and by span length.

    Spans (span_id, text) without overlap fill up with score 0, smallest ids first.
    """
    found, ids = overlap_search(questions, spans, top_k)
    best = settled(ranked(found, ids, "span_id", top_k).drop("rank"))
    # A question with fewer than top_k rows has all its spans there, so the smallest other ids fill up.
    first = [r[0] for r in ids.where(F.col("doc") < 2 * top_k).select("span_id").collect()]
    short = questions.select("question_id").join(best.groupBy("question_id").agg(F.count("*").alias("n")).where(F.col("n") >= top_k), "question_id", "left_anti")
    fill = short.select("question_id", F.explode(F.array(*map(F.lit, first)).cast("array<string>")).alias("span_id"))
    fill = fill.join(best, ["question_id", "span_id"], "left_anti").withColumn("score", F.lit(0.0))
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "span_id")
    return fill.unionByName(best).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
