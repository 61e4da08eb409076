"""Planned runs, parsed answers, run records and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeforge.functions import text as T
from citeforge.operators.judging import settled, with_ordinal

# Baselines whose verdicts a verifier checks, and the labels and verdicts of records.
VERIFIED = ["validator_only", "ledger_validator"]
FAILED = ["unsupported", "contradictory", "insufficient_evidence", "partially_supported"]
REFUSAL = "INSUFFICIENT_EVIDENCE"

ANSWER = (
    "global_answer string, refusal boolean, refusal_reason string, atomic_claims array<struct<claim_id:string,text:string,claim_text:string>>, "
    "citations array<struct<claim_id:string,cited_evidence_id:string,evidence_id:string>>, _corrupt string"
)


def plan_runs(questions: DataFrame, baselines: list[str], count: int | None = None, offset: int = 0, prefix: str = "main_v1") -> DataFrame:
    """(plan_order, run_id, dataset_id, question_id, baseline): a slice of the questions, each with every baseline.

    Questions (dataset_id, question_id) are taken in the order of their ids as text; the slice cuts
    by ordinals that range partitions give, and baselines are few, so nothing is sorted in one task.
    """
    rows = questions.select("dataset_id", F.col("question_id").cast("string").alias("question_id"))
    ordered = with_ordinal(rows, ["question_id", "dataset_id"], "_place").where(F.col("_place") > offset)
    if count is not None:
        ordered = ordered.where(F.col("_place") <= offset + count)
    pairs = ordered.select("*", F.posexplode(F.array(*map(F.lit, baselines))).alias("_b", "baseline"))
    run = F.concat_ws("_", F.lit(prefix), "dataset_id", F.lit("run"), "baseline", "question_id")
    order = (F.col("_place") - offset - 1) * len(baselines) + F.col("_b") + 1
    return pairs.select(order.cast("long").alias("plan_order"), run.alias("run_id"), "dataset_id", "question_id", "baseline")


def unfenced(content: Column) -> Column:
    """A model's output without the lines of a Markdown fence around it."""
    text = T.strip(content)
    lines = F.split(text, T.LINEBREAK, -1)
    body = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    closed = F.startswith(T.strip(F.element_at(lines, -1)), F.lit("```")) & (F.size(lines) > 1)
    body = F.when(closed, F.slice(body, 1, F.greatest(F.size(body) - 1, F.lit(0)))).otherwise(body)
    return F.when(F.startswith(text, F.lit("```")), T.strip(F.array_join(body, "\n"))).otherwise(text)


def parse_answers(rows: DataFrame, content: str = "content") -> DataFrame:
    """Add answer_status (ok, or error for no content or no JSON) and answer, the parsed struct."""
    body = unfenced(F.coalesce(F.col(content), F.lit("")))
    parsed = rows.withColumn("_a", F.from_json(body, ANSWER, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})).withColumn("_empty", body == "")
    good = F.col("_a").isNotNull() & F.col("_a._corrupt").isNull() & ~F.col("_empty")
    return parsed.withColumn("answer_status", F.when(good, "ok").otherwise("error")).withColumn("answer", F.when(good, F.col("_a").dropFields("_corrupt"))).drop("_a", "_empty")


def answer_claims(parsed: DataFrame, *keys: str) -> DataFrame:
    """(keys..., claim_id, claim_text, answer_order): ids default to the claim's place, the text has two names."""
    rows = parsed.select(*keys, F.posexplode("answer.atomic_claims").alias("_i", "c"))
    order = (F.col("_i") + 1).cast("long")
    ident = F.coalesce(T.truthy(F.col("c.claim_id")), F.concat(F.lit("c"), order.cast("string")))
    return rows.select(*keys, ident.alias("claim_id"), T.first_of(F.col("c.text"), F.col("c.claim_text")).alias("claim_text"), order.alias("answer_order"))


def refusal_label(refusal: Column) -> Column:
    return F.when(refusal, "insufficient_evidence").otherwise("answered")


def dry_answer(evidence: Column) -> Column:
    """The answer of a run without a model: a refusal without evidence, else one claim on the first item."""
    claim = F.struct(F.lit("c1").alias("claim_id"), F.lit("Dry run request shape was generated.").alias("text"))
    cited = F.struct(F.lit("c1").alias("claim_id"), F.try_element_at(evidence, F.lit(1)).alias("cited_evidence_id"))
    some = F.coalesce(F.size(evidence), F.lit(0)) > 0
    none = F.array_repeat(claim, 0), F.array_repeat(cited, 0)
    return F.struct(
        F.when(some, "DRY_RUN_NO_MODEL_CALL").otherwise(REFUSAL).alias("global_answer"),
        F.when(some, F.array(claim)).otherwise(none[0]).alias("atomic_claims"),
        F.when(some, F.array(cited)).otherwise(none[1]).alias("citations"),
        (~some).alias("refusal"),
        F.when(some, "").otherwise("no evidence").alias("refusal_reason"),
    )


def run_records(runs: DataFrame, claims: DataFrame, checked: DataFrame) -> DataFrame:
    """One nested record for each run: its claims in order, kept and dropped citations, verdicts, counts.

    ``runs`` has run_id, dataset_id, baseline, refusal_label, prompt_tokens and completion_tokens;
    ``claims`` run_id, claim_id, claim_text and answer_order; ``checked`` the validator's rows. What
    is collected for a run is one answer's own claims and citations.
    """
    by_claim = claims.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("answer_order", "claim_id", "claim_text"))).alias("atomic_claims"))
    valid = F.col("structural_validity") == "valid"
    kept, dropped = F.struct("claim_id", "citation_id"), F.struct("claim_id", "citation_id", F.col("validation_error").alias("reason"))
    by_citation = checked.groupBy("run_id").agg(F.sort_array(F.collect_list(F.when(valid, kept))).alias("citations"), F.sort_array(F.collect_list(F.when(~valid, dropped))).alias("invalid_citations"))
    rows = runs.join(by_claim, "run_id", "left").join(by_citation, "run_id", "left")
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    label = F.when(size("citations") > 0, "not_checked").otherwise("insufficient")
    checked_by = F.col("baseline").isin(VERIFIED)
    verdict = lambda c: F.struct(c["claim_id"].alias("claim_id"), checked_by.alias("verifier_enabled"), label.alias("label"))
    uncited = F.size(F.array_except(F.coalesce(F.transform("atomic_claims", lambda c: c["claim_id"]), F.array().cast("array<string>")), F.coalesce(F.transform("citations", lambda c: c["claim_id"]), F.array().cast("array<string>"))))
    return rows.withColumns(
        {
            "verdicts": F.transform("atomic_claims", verdict),
            "claim_count": size("atomic_claims"),
            "valid_citation_count": size("citations"),
            "invalid_citation_count": size("invalid_citations"),
            "uncited_claim_count": uncited.cast("long"),
            "estimated_cost_usd": T.cost_usd(F.col("prompt_tokens"), F.col("completion_tokens")),
        }
    )


def run_summary(records: DataFrame, *keys: str) -> DataFrame:
    """Totals of run records, over all or by keys; a batch's cost is the sum of its rounded costs."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return records.groupBy(*keys).agg(
        F.count("*").alias("success_count"),
        F.count_if(F.col("refusal_label") != "answered").alias("refusal_count"),
        total("claim_count").alias("claim_count"),
        total("valid_citation_count").alias("valid_citation_count"),
        total("invalid_citation_count").alias("dropped_invalid_citation_count"),
        total("uncited_claim_count").alias("uncited_claim_count"),
        total("prompt_tokens").alias("total_prompt_tokens"),
        total("completion_tokens").alias("total_completion_tokens"),
        F.coalesce(F.sum(F.col("estimated_cost_usd").cast("decimal(18,6)")), F.lit(0)).cast("double").alias("estimated_cost_usd"),
    )


def failures(records: DataFrame) -> DataFrame:
    """Semantic records that failed or were skipped."""
    return records.where(F.col("verdict").isin(FAILED) | (F.col("semantic_status") == "skipped"))


def failure_sample(records: DataFrame, order: list[str], most: int = 12) -> DataFrame:
    """The first ``most`` failures in the records' order."""
    return failures(records).orderBy(*order).limit(most)


def running_totals(rows: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """Sums of columns over all rows up to each one by ``order``, as total_<column>; no task sees all rows."""
    spread = settled(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    upto = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = spread.withColumns({f"_{c}": F.sum(c).over(upto) for c in columns})
    sums = spread.groupBy("_part").agg(*[F.sum(c).alias(f"_before_{c}") for c in columns])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    before = sums.select("_part", *[F.coalesce(F.sum(f"_before_{c}").over(earlier), F.lit(0)).alias(f"_before_{c}") for c in columns])
    out = local.join(F.broadcast(before), "_part").withColumns({f"total_{c}": F.coalesce(f"_{c}", F.lit(0)) + F.col(f"_before_{c}") for c in columns})
    return out.select(*rows.columns, *[f"total_{c}" for c in columns])


def until_errors(rows: DataFrame, order: list[str], failed: Column, most: int = 2) -> DataFrame:
    """Rows up to the one whose error is beyond the ``most`` that a batch may have."""
    marked = running_totals(rows.withColumn("_failed", failed.cast("int")), order, ["_failed"])
    return marked.where((F.col("total__failed") <= most) | ((F.col("total__failed") == most + 1) & (F.col("_failed") == 1))).drop("_failed", "total__failed")


# The pilot without a model


def offline_answers(questions: DataFrame, retrieved: DataFrame, support: DataFrame) -> DataFrame:
    """(question_id, claim_id, claim_text, answer_order, refusal_label, source_doc_id): expected claims on
    the first retrieved document that supports the question, else the first one.

    ``questions`` has question_id, case_type and expected_claims; a question of case type
    insufficient has one claim, the refusal, without a citation.
    """
    known = support.select("question_id", "source_doc_id").distinct().withColumn("_s", F.lit(0))
    ranked = retrieved.join(known, ["question_id", "source_doc_id"], "left")
    best = ranked.groupBy("question_id").agg(F.min_by("source_doc_id", F.struct(F.coalesce("_s", F.lit(1)), "rank")).alias("_doc"))
    refused = F.col("case_type") == "insufficient"
    rows = questions.select("question_id", refused.alias("_r"), F.posexplode(F.when(refused, F.array(F.lit(REFUSAL))).otherwise(F.col("expected_claims"))).alias("_i", "claim_text"))
    rows = rows.join(best, "question_id", "left")
    order = (F.col("_i") + 1).cast("long")
    return rows.select("question_id", F.concat(F.col("question_id").cast("string"), F.lit("_claim_"), order.cast("string")).alias("claim_id"), "claim_text", order.alias("answer_order"), refusal_label(F.col("_r")).alias("refusal_label"), F.when(~F.col("_r"), F.col("_doc")).alias("source_doc_id"))


def offline_verdicts(claims: DataFrame, citations: DataFrame, expected: DataFrame, support: DataFrame) -> DataFrame:
    """Label and score of each claim: support where it is expected and its last citation is a support document.

    ``claims`` has question_id, claim_id, claim_text and refusal_label; ``citations`` question_id,
    claim_id, position and source_doc_id; ``expected`` question_id and claim_text.
    """
    last = citations.groupBy("question_id", "claim_id").agg(F.max_by("source_doc_id", "position").alias("_doc"))
    rows = claims.join(last, ["question_id", "claim_id"], "left")
    rows = rows.join(expected.select("question_id", "claim_text").distinct().withColumn("_e", F.lit(True)), ["question_id", "claim_text"], "left")
    known = support.select("question_id", F.col("source_doc_id").alias("_doc")).distinct().withColumn("_s", F.lit(True))
    rows = rows.join(known, ["question_id", "_doc"], "left")
    refused = F.col("refusal_label") == "insufficient_evidence"
    good = F.coalesce(F.col("_e") & F.col("_s"), F.lit(False))
    label = F.when(~refused & good, "support").otherwise("insufficient")
    return rows.select("question_id", "claim_id", label.alias("label"), F.when(refused | good, 1.0).otherwise(0.0).alias("score"))
