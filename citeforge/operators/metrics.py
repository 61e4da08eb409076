"""Rates over validations, semantic records and runs, on any grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeforge.functions import text as T
from citeforge.operators.judging import settled

# Verdict names, and below the names of metrics and recommendations.
VERDICTS = ["entailed", "partially_supported", "contradictory", "unsupported", "insufficient_evidence"]


def _count(condition: Column) -> Column:
    return F.count_if(condition)


def validation_counts() -> dict[str, Column]:
    """Counts over validation rows; rows without a citation (null status) count nowhere."""
    error = F.col("validation_error")
    return {
        "citation_count": F.count("validator_status"),
        "valid_citation_count": _count(F.col("structural_validity") == "valid"),
        "malformed_citation_count": _count(error == "malformed_citation_id"),
        "nonexistent_citation_count": _count(error == "nonexistent_citation_id"),
        "not_retrieved_citation_count": _count(error == "not_in_retrieved_evidence"),
        "wrong_snapshot_hash_count": _count(error == "wrong_snapshot_hash"),
        "wrong_span_hash_count": _count(error == "wrong_span_hash"),
        "span_replay_count": _count(F.col("span_replay_success")),
        "snapshot_replay_count": _count(F.col("snapshot_replay_success")),
    }


def validation_rates(counts: DataFrame) -> DataFrame:
    total = F.col("citation_count")
    rates = {
        "invalid_citation_rate": total - F.col("valid_citation_count"),
        "citation_id_validity_rate": F.col("valid_citation_count"),
        "not_in_retrieved_evidence_rate": F.col("not_retrieved_citation_count"),
        "malformed_citation_rate": F.col("malformed_citation_count"),
        "wrong_snapshot_hash_rate": F.col("wrong_snapshot_hash_count"),
        "wrong_span_hash_rate": F.col("wrong_span_hash_count"),
        "span_replay_success_rate": F.col("span_replay_count"),
        "snapshot_replay_success_rate": F.col("snapshot_replay_count"),
    }
    return counts.withColumns({"invalid_citation_count": total - F.col("valid_citation_count")} | {k: T.rate(n, total) for k, n in rates.items()})


def semantic_counts() -> dict[str, Column]:
    named = {f"{v}_count": _count(F.col("verdict") == v) for v in VERDICTS}
    return named | {"semantic_record_count": F.count("semantic_status"), "skipped_count": _count(F.col("semantic_status") == "skipped"), "evaluated_count": _count(F.col("semantic_status") == "evaluated")}


def semantic_rates(counts: DataFrame) -> DataFrame:
    """Shares among all records, skipped ones included, and among evaluated ones beside them."""
    over = {f"{v}_rate": T.rate(F.col(f"{v}_count"), F.col("semantic_record_count")) for v in VERDICTS}
    over["skipped_rate"] = T.rate(F.col("skipped_count"), F.col("semantic_record_count"))
    over["entailed_rate_of_evaluated"] = T.rate(F.col("entailed_count"), F.col("evaluated_count"))
    return counts.withColumns(over)


def audit(runs: DataFrame, claims: DataFrame, records: DataFrame) -> DataFrame:
    """All rates overall, by dataset, by baseline and by both, with the three claim coverages.

    ``runs`` has run_id, dataset_id, baseline and refusal_label; ``claims`` the first three and
    claim_id; ``records`` (semantic records) these and the validator's columns. Each grain is
    reduced on its own with one cube and the three small results are joined; the records, without
    texts, are written once for their two grains.
    """
    keys = ["dataset_id", "baseline"]
    records = settled(records.select("run_id", *keys, "claim_id", "validator_status", "structural_validity", "validation_error", "span_replay_success", "snapshot_replay_success", "semantic_status", "verdict"))
    cube = lambda df, **aggs: df.cube(*keys).agg(F.grouping_id().alias("grouping"), *[c.alias(n) for n, c in aggs.items()])
    by_run = cube(runs, record_count=F.count("*"), refusal_count=_count(F.coalesce(F.col("refusal_label") != "answered", F.lit(True))))
    cited = records.groupBy("run_id", "claim_id").agg(F.lit(1).alias("any_citation"), F.max(F.when(F.col("structural_validity") == "valid", 1)).alias("valid_citation"))
    covered = claims.select("run_id", *keys, "claim_id").distinct().join(cited, ["run_id", "claim_id"], "left")
    by_claim = cube(covered, claim_count=F.count("*"), covered_any=F.count("any_citation"), covered_valid=F.count("valid_citation"))
    by_record = cube(records, **validation_counts(), **semantic_counts())
    on = [*keys, "grouping"]
    same = lambda df, tag: df.select(*[F.col(k).alias(f"{tag}_{k}") for k in on], *[c for c in df.columns if c not in on])
    joined = by_run
    for tag, df in (("c", by_claim), ("r", by_record)):
        match = [F.col(k).eqNullSafe(F.col(f"{tag}_{k}")) for k in on]
        joined = joined.join(same(df, tag), match[0] & match[1] & match[2], "left").drop(*[f"{tag}_{k}" for k in on])
    counts = [c for c in joined.columns if c not in on]
    joined = joined.fillna(0, subset=counts)
    out = semantic_rates(validation_rates(joined))
    return out.withColumns(
        {
            "refusal_rate": T.rate(F.col("refusal_count"), F.col("record_count")),
            "coverage_any_validation": T.rate(F.col("covered_any"), F.col("claim_count")),
            "coverage_valid": T.rate(F.col("covered_valid"), F.col("claim_count")),
        }
    )


def by_baseline(runs: DataFrame, claims: DataFrame, records: DataFrame) -> DataFrame:
    """Structural and semantic metrics of each baseline, from three grains that are reduced first.

    ``runs`` has baseline, text and refusal_label, ``claims`` baseline, ``records`` run_id, claim_id,
    baseline and the columns of semantic records.
    """
    valid = F.when(F.col("structural_validity") == "valid", F.struct("run_id", "claim_id"))
    x = records.groupBy("baseline").agg(*[c.alias(n) for n, c in (validation_counts() | semantic_counts()).items()], F.count_distinct(valid).alias("cited_claims"))
    y = runs.groupBy("baseline").agg(F.count("*").alias("run_record_count"), F.sum(F.length("text")).alias("chars"), _count(F.col("refusal_label") != "answered").alias("refusals"))
    z = claims.groupBy("baseline").agg(F.count("*").alias("claim_count"))
    rows = semantic_rates(validation_rates(y.join(x, "baseline").join(z, "baseline")))
    over = {
        "claim_count_per_answer": ("claim_count", "run_record_count"),
        "citation_count_per_answer": ("citation_count", "run_record_count"),
        "claim_citation_coverage": ("cited_claims", "claim_count"),
        "answer_length": ("chars", "run_record_count"),
        "refusal_rate": ("refusals", "run_record_count"),
    }
    return rows.withColumns({k: T.rate(F.col(a), F.col(b)) for k, (a, b) in over.items()}).drop("chars", "refusals", "cited_claims")


def review(runs: DataFrame) -> DataFrame:
    """Run statistics overall and by baseline, with a recommendation.

    ``runs`` has baseline, support_hit, refusal, citation_count, claim_count, prompt_tokens,
    completion_tokens and cost.
    """
    rows = runs.rollup("baseline").agg(
        F.grouping_id().alias("grouping"),
        F.count("*").alias("record_count"),
        _count(F.col("support_hit")).alias("support_hit_count"),
        _count(F.col("refusal")).alias("refusal_count"),
        F.sum("citation_count").alias("citation_count"),
        F.sum("claim_count").alias("claim_count"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.bround(F.sum("cost"), 6).alias("estimated_cost_usd"),
    )
    rows = rows.withColumns(
        {
            "support_hit_rate": T.rate(F.col("support_hit_count"), F.col("record_count")),
            "refusal_rate": T.rate(F.col("refusal_count"), F.col("record_count")),
            "claim_to_citation_rate": T.rate(F.col("citation_count"), F.col("claim_count")),
        }
    )
    advice = F.when(F.col("support_hit_rate") < 0.8, "fix_retrieval_before_scaling").when(F.col("refusal_rate") > 0.5, "inspect_prompt_refusal_behavior_before_scaling").otherwise("eligible_for_larger_mini_run")
    return rows.withColumn("recommendation", advice)


def retrieval_metrics(ranked: DataFrame, support: DataFrame, questions: DataFrame) -> DataFrame:
    """Hit rate, precision and mean reciprocal rank over all questions.

    ``ranked`` has question_id, source_doc_id and rank; ``support`` the relevant documents.
    """
    marked = ranked.join(support.select("question_id", "source_doc_id").distinct().withColumn("relevant", F.lit(1)), ["question_id", "source_doc_id"], "left")
    per = marked.groupBy("question_id").agg(F.count("*").alias("n"), F.count("relevant").alias("hits"), F.min(F.when(F.col("relevant") == 1, F.col("rank"))).alias("first"))
    every = questions.select("question_id").join(per, "question_id", "left")
    hit = F.when(F.coalesce("hits", F.lit(0)) > 0, 1.0).otherwise(0.0)
    precision = F.coalesce("hits", F.lit(0)).cast("double") / F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))
    mean = lambda c: F.coalesce(F.bround(F.avg(c), 6), F.lit(0.0))
    return every.agg(F.count("*").alias("question_count"), mean(hit).alias("recall_at_k"), mean(precision).alias("precision_at_k"), mean(F.coalesce(1 / F.col("first").cast("double"), F.lit(0.0))).alias("mrr"))
