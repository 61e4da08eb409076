"""Readiness rules over registries: one row for each rule that a record breaks.

A rule is a predicate over a record's columns with a field and a message; all rules are evaluated in
one pass, as an array of structs of which the broken ones are exploded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeforge.functions import text as T

# The fields of a snapshot record that must be set before it is ready.
READINESS_FIELDS = [
    "license_note",
    "source_snapshot_id",
    "dataset_path",
    "raw_data_hash",
    "processed_corpus_hash",
    "split_hash",
    "build_command_record",
    "retrieval_index_path",
]
STORAGE_CLASSES = ["small", "medium", "large", "unknown"]
STATUSES = ["pending", "source_ready", "ready"]


@dataclass(frozen=True)
class Rule:
    """``broken`` holds where the record fails."""

    field: str
    message: str
    broken: Column


def blockers(records: DataFrame, rules: list[Rule], *keys: str) -> DataFrame:
    """(keys..., field, message) of each broken rule of each record."""
    checks = F.array(*[F.when(F.coalesce(r.broken, F.lit(True)), F.struct(F.lit(r.field).alias("field"), F.lit(r.message).alias("message"))) for r in rules])
    return records.select(*keys, F.explode(F.array_compact(checks)).alias("b")).select(*keys, "b.field", "b.message")


def snapshot_rules() -> list[Rule]:
    """A snapshot is ready when all fields are locked and its enumerations are known ones."""
    rules = [Rule(f, f"{f} is not locked", T.is_unset(F.col(f))) for f in READINESS_FIELDS]
    rules.append(Rule("status", "snapshot status is not ready", F.col("status") != "ready"))
    rules.append(Rule("status", "invalid status", ~F.col("status").isin(STATUSES)))
    rules.append(Rule("storage_class", "invalid storage class", ~F.col("storage_class").isin(STORAGE_CLASSES)))
    rules.append(Rule("dataset_path", "path has unsafe parts", F.exists(F.split("dataset_path", "/"), lambda p: ~T.is_safe_component(p))))
    return rules


def registry_errors(records: DataFrame, key: str, required: list[str], allowed: dict[str, list[str]], expected: DataFrame) -> DataFrame:
    """(record, field, message): duplicate ids, expected ids that are missing, fields that are not
    there and values that are not among the allowed ones."""
    named = lambda df, message: df.select(F.col(key).alias("record"), F.lit(key).alias("field"), F.lit(message).alias("message"))
    missing = set_differences(expected, records, key).where("problem = 'missing'")
    rules = [Rule(f, "required field is missing", F.col(f).isNull()) for f in required]
    rules += [Rule(f, "unknown value", ~F.col(f).isin(values)) for f, values in allowed.items()]
    broken = blockers(records, rules, key).distinct().withColumnRenamed(key, "record")
    return named(duplicates(records, key), "duplicate id").union(named(missing, "expected id is missing")).union(broken)


def source_gate(records: DataFrame, found: DataFrame, key: str = "dataset_id") -> DataFrame:
    """What keeps sources from being indexed: hashes that are not locked, or not those of the data.

    ``found`` has the key and found_hash, the digest of the corpus as it is.
    """
    fields = ["raw_data_hash", "processed_corpus_hash", "split_hash"]
    rules = [Rule(f, f"{f} is not locked", T.is_unset(F.col(f))) for f in fields]
    rules.append(Rule("processed_corpus_hash", "corpus is not the recorded one", ~F.col("processed_corpus_hash").eqNullSafe(F.col("found_hash")) | F.col("processed_corpus_hash").isNull()))
    return blockers(records.join(found, key, "left"), rules, key)


def duplicates(records: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return records.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def set_differences(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side that lacks them."""
    missing = expected.select(key).distinct().join(actual, key, "left_anti").withColumn("problem", F.lit("missing"))
    extra = actual.select(key).distinct().join(expected, key, "left_anti").withColumn("problem", F.lit("unexpected"))
    return missing.union(extra)


def field_mismatches(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields that differ between the records of equal key; a missing record differs in all."""
    both = left.select(key, *[F.col(f).cast("string").alias(f"l_{f}") for f in fields]).join(right.select(key, *[F.col(f).cast("string").alias(f"r_{f}") for f in fields]), key, "left")
    checks = F.array(*[F.when(~F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}")), F.struct(F.lit(f).alias("field"), F.col(f"l_{f}").alias("expected"), F.col(f"r_{f}").alias("actual"))) for f in fields])
    return both.select(key, F.explode(F.array_compact(checks)).alias("d")).select(key, "d.*")


def promotable(registry: DataFrame, manifests: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Registry records updated from index manifests, only where no rule is broken by then."""
    fresh = manifests.select(key, F.col("index_path").alias("_path"), F.col("index_hash").alias("_hash"))
    merged = registry.join(fresh, key, "left").withColumn("retrieval_index_path", F.coalesce("_path", "retrieval_index_path")).withColumn("status", F.when(F.col("_hash").isNotNull(), "ready").otherwise(F.col("status")))
    blocked = blockers(merged, snapshot_rules(), key).select(key).distinct().withColumn("_blocked", F.lit(True))
    return merged.drop("_path", "_hash").join(blocked, key, "left").withColumn("promoted", F.col("_blocked").isNull()).drop("_blocked")
