"""A store of judges' answers by content: a pair of claim and span is judged once for each judge.

Answers are appended in versions of a folder (see ``snapshots``), so of a run that breaks either all
answers are there or none, and a task that runs twice writes once. Failed calls are not stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeforge.functions import text as T
from citeforge.operators.judging import Judge, apply_judge, settled
from citeforge.operators.snapshots import Conflict, Versions

_ANSWER = ["judge_status", "judge_label", "judge_confidence", "judge_rationale"]


class JudgeMemo:
    """The answers of one judge, named with its version and prompt, in a folder."""

    def __init__(self, spark: SparkSession, folder: str, judge_name: str):
        self.versions, self.judge_name = Versions(spark, folder), judge_name

    def key(self, claim: Column, span: Column) -> Column:
        """The pair's address; lengths keep its parts apart."""
        parts = [F.lit(self.judge_name), claim, span]
        return T.sha256(F.concat(*[x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p)]))

    def answers(self) -> DataFrame | None:
        """(key, the judge's columns); of a pair that two runs judged at once the earlier answer counts."""
        rows = None
        for n in range(1, self.versions.newest() + 1):
            part = self.versions.read("answers", n).select("key", *_ANSWER, F.lit(n).alias("_n"))
            rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            return None
        return rows.groupBy("key").agg(F.min_by(F.struct(*_ANSWER), "_n").alias("_a")).select("key", "_a.*")

    def _store(self, labelled: DataFrame) -> None:
        staged = self.versions.stage({"answers": labelled})
        while True:
            newest = self.versions.newest()
            try:
                self.versions.publish(newest, staged, {})
                return
            except Conflict:
                continue  # another run has appended meanwhile; keys are what they are

    def label(self, items: DataFrame, judge: Judge, attempts: int = 3, wait: float = 0.0, limit: int | None = None) -> DataFrame:
        """``apply_judge`` with the store: items (claim_text, cited_span_text) and their answers, with ``from_store``.

        Only distinct pairs without an answer are judged, at most ``limit`` of them; an item whose
        pair is beyond it has status pending, one without a span is skipped.
        """
        filled = F.trim(F.coalesce("cited_span_text", F.lit(""))) != ""
        keyed = settled(items.withColumn("_key", F.when(filled, self.key(F.coalesce("claim_text", F.lit("")), F.col("cited_span_text")))))
        pairs = keyed.where("_key is not null").groupBy(F.col("_key").alias("key")).agg(F.first("claim_text").alias("claim_text"), F.first("cited_span_text").alias("cited_span_text"))
        known = self.answers()
        if known is not None:
            known = settled(known.join(pairs.select("key"), "key", "left_semi"))
            pairs = pairs.join(known.select("key"), "key", "left_anti")
        if limit is not None:
            pairs = pairs.orderBy("key").limit(limit)
        fresh = settled(apply_judge(pairs, judge, attempts, wait).select("key", *_ANSWER, F.lit(False).alias("from_store")))
        labelled = fresh.where("judge_status = 'labeled'").drop("from_store")
        if not labelled.isEmpty():
            self._store(labelled)
        every = fresh if known is None else fresh.unionByName(known.withColumn("from_store", F.lit(True)))
        rows = keyed.join(every.withColumnRenamed("key", "_key"), "_key", "left").drop("_key")
        status = F.coalesce("judge_status", F.when(filled, "pending").otherwise("skipped"))
        none = {"judge_label": "", "judge_confidence": 0.0, "judge_rationale": ""}
        return rows.withColumn("judge_status", status).withColumns({c: F.coalesce(c, F.lit(v)) for c, v in none.items()}).withColumn("from_store", F.coalesce("from_store", F.lit(False)))
