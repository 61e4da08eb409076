"""Incremental validation as a query."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeforge.operators.incremental import ValidationStore
from citeforge.operators.judging import settled
from citeforge.plans import tables as B
from citeforge.plans.registry import query
from citeforge.sources.folders import new_folder


@query(f"WITH {B.VALIDATED} SELECT run_id, claim_id, validator_status, structural_validity, in_retrieved_evidence, conv_id % 3 <> 0 AND conv_id % 5 <> 0 AS reused FROM v")
def incremental_validation(spark, d):
    """Validations after an update: every third conversation's citations have changed and every fifth's are new."""
    held = settled(B.ledger(spark, d))
    rows = settled(B.citations(spark, d, held).select("conv_id", "run_id", "claim_id", "citation_id"))
    store = ValidationStore(spark, new_folder(spark, "validations"), ["run_id", "claim_id"])
    before = rows.where("conv_id % 5 <> 0").withColumn("citation_id", F.when(F.col("conv_id") % 3 == 0, F.concat("citation_id", F.lit("x"))).otherwise(F.col("citation_id")))
    store.update(before, held, B.retrieved(held))
    out = store.update(rows, held, B.retrieved(held))
    return out.select("run_id", "claim_id", "validator_status", "structural_validity", "in_retrieved_evidence", "reused")
