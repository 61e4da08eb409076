"""Annotation rows, judge labels, and comparisons between judges."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeforge.functions import text as T
from citeforge.sources.folders import new_folder

# Label names, and the order in which labels are audited.
LABELS = ["entailed", "partially_supported", "unsupported", "contradictory", "insufficient_evidence"]
AUDIT_PRIORITY = ["contradictory", "partially_supported", "unsupported", "insufficient_evidence", "entailed"]


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so that all that is built on it sees the same rows
    and reads only the columns it needs."""
    spark = df.sparkSession
    folder = new_folder(spark, "settled")
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def with_ordinal(rows: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """Consecutive numbers from 1 over all rows by ``order``, without one task seeing all rows.

    Rows are range-partitioned, numbered in each partition, and shifted by the partitions before.
    """
    spread = settled(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    local = spread.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = local.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = F.broadcast(before.drop("_size"))  # a row for each partition
    return local.join(before, "_part").withColumn(name, F.col("_n") + F.col("_before")).drop("_part", "_n", "_before")


def with_group_ordinal(rows: DataFrame, keys: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    """Consecutive numbers from 1 in each group of ``keys`` by ``order``; no task sees a whole large group.

    As ``with_ordinal``, with counts for each partition and group; null keys are a group of their own.
    """
    spread = settled(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    local = spread.withColumn("_n", F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order)))
    sizes = spread.groupBy("_part", *keys).agg(F.count("*").alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    before = before.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_before")
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return local.join(before, same).withColumn(name, F.col("_n") + F.col("_before")).select(*rows.columns, name)


def annotation_rows(records: DataFrame, include_invalid: bool = False) -> DataFrame:
    """Rows for annotators from semantic records; valid citations alone unless asked otherwise.

    ``valid_ordinal`` numbers a run's valid citations; annotation_id is built from it.
    """
    order = Window.partitionBy("run_id").orderBy("citation_ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    valid = F.col("structural_validity") == "valid"
    rows = records.withColumn("valid_ordinal", F.sum(F.when(valid, 1).otherwise(0)).over(order))
    rows = rows if include_invalid else rows.where(valid)
    ident = F.concat_ws("__", "dataset_id", "run_id", "baseline", "claim_id", F.col("valid_ordinal").cast("string"))
    return rows.withColumn("annotation_id", ident)


Judge = Callable[[dict], dict]


def apply_judge(items: DataFrame, judge: Judge, attempts: int = 3, wait: float = 0.0) -> DataFrame:
    """Call ``judge`` for each row (a dict with claim_text and cited_span_text) in the tasks.

    It returns label, confidence and rationale. Rows without a span are skipped; a call that fails is
    tried again after ``wait`` seconds, twice as long each time, and one that still fails after
    ``attempts`` tries gives status error and does not stop the others.
    """

    def label(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [_labelled(row, judge, attempts, wait) for row in frame.to_dict("records")]
            extra = pd.DataFrame(out, columns=["judge_status", "judge_label", "judge_confidence", "judge_rationale"], index=frame.index)
            yield pd.concat([frame, extra], axis=1)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return items.mapInPandas(label, f"{kinds}, judge_status string, judge_label string, judge_confidence double, judge_rationale string")


def _labelled(row: dict, judge: Judge, attempts: int, wait: float) -> tuple:
    if not (row.get("cited_span_text") or "").strip():
        return "skipped", "", 0.0, ""
    error = ""
    for k in range(attempts):
        if k and wait:
            time.sleep(wait * 2 ** (k - 1))
        try:
            answer = judge(row)
            if answer.get("label") not in LABELS:
                raise ValueError(f"label {answer.get('label')!r}")
            try:
                sure = min(1.0, max(0.0, float(answer.get("confidence") or 0)))
            except (TypeError, ValueError):
                sure = 0.0
            return "labeled", answer["label"], sure, str(answer.get("rationale") or "")
        except Exception as e:  # any failure of a remote judge is a row's status
            error = str(e)
    return "error", "", 0.0, error


def last_labels(rows: DataFrame, order: str, *keys: str) -> DataFrame:
    """The last row of each key."""
    pick = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), order).alias("_row"))
    return pick.select(*keys, "_row.*")


def compare_labels(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows in both tables with both labels and what changed."""
    both = old.select("annotation_id", F.col("judge_label").alias("old_label")).join(new.select("annotation_id", F.col("judge_label").alias("new_label")), "annotation_id")
    softer = F.col("new_label").isin("insufficient_evidence", "partially_supported", "unsupported")
    changed = F.col("old_label") != F.col("new_label")
    return both.withColumns({"changed": changed, "from_contradictory": changed & (F.col("old_label") == "contradictory"), "from_entailed": changed & (F.col("old_label") == "entailed") & softer})


def comparison_summary(compared: DataFrame) -> DataFrame:
    """One row: how many labels were compared and changed, and the changes that matter most."""
    n = F.count("*")
    counts = {"changed_count": "changed", "from_contradictory_count": "from_contradictory", "from_entailed_count": "from_entailed"}
    rate = F.coalesce(F.try_divide(F.count_if("changed").cast("double"), n.cast("double")), F.lit(0.0))
    return compared.agg(n.alias("compared_count"), *[F.count_if(c).alias(k) for k, c in counts.items()], rate.alias("disagreement_rate"))


def label_distribution(rows: DataFrame, column: str = "judge_label") -> DataFrame:
    """Count of each label; the known ones are there with 0 too, others follow."""
    known = rows.sparkSession.createDataFrame([(x,) for x in LABELS], "label string")
    counted = rows.groupBy(F.coalesce(F.col(column), F.lit("")).alias("label")).agg(F.count("*").alias("n"))
    return known.join(counted, "label", "full_outer").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def confusion(compared: DataFrame) -> DataFrame:
    """A row for each old label, a column for each new one."""
    table = compared.groupBy("old_label").pivot("new_label", LABELS).count().na.fill(0)
    return table


def audit_subset(rows: DataFrame, order: Column | str, size: int = 50) -> DataFrame:
    """Up to ``size`` rows for a manual audit, most doubtful labels first; other labels never."""
    rank = F.array_position(F.array(*map(F.lit, AUDIT_PRIORITY)), F.col("judge_label"))
    return rows.withColumn("priority", rank).where("priority > 0").orderBy("priority", order).limit(size)
