"""Scans: JSON lines and documents, archives' members, files' bytes, settings."""

from __future__ import annotations

import os
import posixpath
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Explicit schemas; none is ever inferred.
CLAIM = "struct<claim_id:string,claim_text:string,text:string>"
CITATION = "struct<claim_id:string,citation_id:string,cited_evidence_id:string,evidence_id:string>"
EVIDENCE = "struct<rank:int,score:double,evidence_id:string,ledger_span_id:string,source_doc_id:string,source_hash:string,citation_id:string,title:string,text:string>"
RUN_RECORD = (
    "input struct<dataset_id:string,question_id:string,question_text:string>, "
    f"retrieved_evidence array<{EVIDENCE}>, "
    "ledger_spans array<struct<dataset_id:string,source_id:string,snapshot_hash:string,span_id:string,text:string,span_hash:string>>, "
    f"answer struct<global_answer:string,refusal_label:string,atomic_claims:array<{CLAIM}>>, "
    f"citations array<{CITATION}>, "
    "run_metadata struct<run_id:string,baseline_family:string,usage:struct<prompt_tokens:long,completion_tokens:long>,estimated_cost_usd:double,latency_ms:double>"
)
QA_RECORD = "_id string, id string, question string, answer string, type string, level string, supporting_facts string, context string"


def json_lines(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Line-delimited JSON; blank lines are skipped, a malformed line fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document, an object or an array of records."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def tagged_union(tables: dict[str, DataFrame], column: str = "dataset_id") -> DataFrame:
    """All tables' rows, each with the part of its key before a double underscore."""
    out = None
    for key, df in tables.items():
        tagged = df.withColumn(column, F.lit(key.split("__", 1)[0]))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no tables")
    return out


def read_if_exists(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at a path, or an empty one where there is none (a run's first start)."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    return json_lines(spark, path, schema) if there else spark.createDataFrame([], schema)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and SHA-256 of files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def member_name(names: list[str], split: str, suffix: str = ".json", first: bool = False) -> str:
    """The member of an archive that holds a split: ``data_ids`` first, the top next, else the only
    one, or the ``first`` of several where that is asked for."""
    for name in (f"data_ids/{split}{suffix}", f"{split}{suffix}"):
        if name in names:
            return name
    found = [n for n in names if posixpath.basename(n) == f"{split}{suffix}" or n.endswith(f"_{split}{suffix}")]
    if first and found:
        return found[0]
    if len(found) != 1:
        raise ValueError(f"{len(found)} members for split {split}")
    return found[0]


def extract_member(archive: str, split: str, folder: str, suffix: str = ".json", first: bool = False) -> str:
    """Extract a split's member next to the other inputs and return its path for a reader."""
    with zipfile.ZipFile(archive) as z:
        name = member_name(z.namelist(), split, suffix, first)
        target = os.path.join(folder, posixpath.basename(name))
        with z.open(name) as source, open(target, "wb") as out:
            while chunk := source.read(1 << 20):
                out.write(chunk)
    return target


def qa_records(records: DataFrame) -> DataFrame:
    """Question-answering records whose context and facts are two-element arrays of mixed types."""
    context = F.from_json("context", "array<array<string>>")
    facts = F.from_json("supporting_facts", "array<array<string>>")
    return records.select(
        F.coalesce(F.nullif("_id", F.lit("")), "id").alias("question_id"),
        F.col("question").alias("question_text"),
        "answer",
        F.transform(context, lambda c: F.struct(c[0].alias("title"), F.from_json(c[1], "array<string>").alias("sentences"))).alias("context"),
        F.transform(F.coalesce(facts, F.expr("cast(array() as array<array<string>>)")), lambda f: F.struct(f[0].alias("title"), f[1].cast("int").alias("sentence_index"))).alias("facts"),
    )


def only_record(records: DataFrame, key: str, value: str) -> DataFrame:
    """The record of a registry that has a key; it is an error if there is none."""
    found = records.where(F.col(key) == value).limit(1)
    if found.isEmpty():
        raise ValueError(f"no record with {key} {value}")
    return found


def settings(path: str | None, names: list[str]) -> dict[str, str]:
    """KEY=VALUE lines; comments are skipped, quotes dropped, and the environment wins."""
    found: dict[str, str] = {}
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as lines:
            for line in lines:
                key, sep, value = line.strip().partition("=")
                if sep and not key.startswith("#"):
                    found[key.strip()] = value.strip().strip("\"'")
    return {n: os.environ.get(n, found.get(n, "")) for n in names}


def flat_yaml(lines: DataFrame) -> DataFrame:
    """(key, value) of the top-level scalars of simple YAML, from a table of lines (value)."""
    parts = lines.where(~F.col("value").rlike(r"^\s*(#|$)") & F.col("value").rlike(r"^[A-Za-z_][A-Za-z0-9_]*:"))
    return parts.select(F.regexp_extract("value", r"^([A-Za-z0-9_]+):", 1).alias("key"), F.trim(F.regexp_extract("value", r"^[A-Za-z0-9_]+:\s*(.*?)\s*$", 1)).alias("value"))
