"""Published snapshots and versioned registries: staged tables that one small file makes current.

Tables are staged under names of their own, read back, counted and digested, and only then named by
the next version's file, which is made once (``put_once``). A reader follows the newest version and
keeps the tables that it names, whatever is published meanwhile; a build that fails, or that comes
second for the same version, leaves nothing that a reader sees.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeforge.functions import text as T
from citeforge.operators import evidence as E
from citeforge.operators.sizing import small
from citeforge.sources.folders import put_once, read_text
from citeforge.sources.writers import canonical_json


class Conflict(Exception):
    """Another writer has made the version that was to follow the expected one."""


class Versions:
    """Numbered versions of named tables in a folder, from 1 on."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def entry(self, version: int) -> dict | None:
        text = read_text(self.spark, f"{self.folder}/versions/{version:09d}.json")
        return json.loads(text) if text else None

    def newest(self) -> int:
        """The number of the newest version; 0 before the first. Doubled steps and a bisection find it."""
        there = lambda n: self.entry(n) is not None
        high = 1
        while there(high):
            high *= 2
        low = high // 2
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if there(middle) else (low, middle)
        return low

    def stage(self, tables: dict[str, DataFrame]) -> dict[str, str]:
        """Write tables where no reader looks; their folders by name."""
        place = f"{self.folder}/tables/{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{place}/{name}")
        return {name: f"{place}/{name}" for name in tables}

    def publish(self, expected: int, staged: dict[str, str], facts: dict) -> int:
        """Make staged tables the version after ``expected``; ``Conflict`` where that is there already."""
        if expected and self.entry(expected) is None:
            raise Conflict(f"version {expected} is not there")
        if not put_once(self.spark, f"{self.folder}/versions/{expected + 1:09d}.json", json.dumps({"tables": staged, "facts": facts}, sort_keys=True)):
            raise Conflict(f"version {expected + 1} is there already")
        return expected + 1

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table of a version, the newest one unless another is asked for."""
        entry = self.entry(self.newest() if version is None else version)
        if entry is None:
            raise ValueError(f"no version {version or ''} in {self.folder}")
        return self.spark.read.parquet(entry["tables"][name])


# Snapshots


def publish_snapshot(versions: Versions, corpus: DataFrame, questions: DataFrame, source_version: str = "official", check: Callable[[DataFrame], None] | None = None) -> int:
    """Stage a corpus and its questions, record them and make the two one version.

    ``corpus`` has dataset_id, split, source_doc_id, source_uri and text, ``questions`` dataset_id and
    question_id. The table ``record`` has a row for each dataset and split: counts, digests of the
    staged rows in the order of their ids, and the snapshot id that follows from them. ``check`` may
    look at it and raise, which publishes nothing.
    """
    spark, expected = versions.spark, versions.newest()
    rows = corpus.select("dataset_id", "split", "source_doc_id", "source_uri", "text", T.sha256(F.coalesce("text", F.lit(""))).alias("source_hash"))
    staged = versions.stage({"corpus": rows, "questions": questions})
    written, asked = (spark.read.parquet(staged[n]) for n in ("corpus", "questions"))
    keys = ["dataset_id", "split"]
    counted = written.groupBy(*keys).agg(F.count("*").alias("corpus_doc_count"))
    # Texts are hashed already, so a row stands for itself by ids and hash.
    by_row = E.ordered_digest(written.select(*keys, "source_doc_id", "source_uri", "source_hash"), "source_doc_id", F.concat_ws("|", "source_doc_id", "source_uri", "source_hash"), *keys)
    ids = asked.groupBy("dataset_id").agg(F.count("*").alias("question_count"))
    by_question = E.ordered_digest(asked, "question_id", F.col("question_id").cast("string"), "dataset_id").withColumnRenamed("corpus_hash", "split_hash")
    # A split may be null.
    by_row = by_row.select(F.col("dataset_id").alias("_d"), F.col("split").alias("_s"), F.col("corpus_hash").alias("processed_corpus_hash"))
    record = counted.join(by_row, F.col("dataset_id").eqNullSafe(F.col("_d")) & F.col("split").eqNullSafe(F.col("_s"))).drop("_d", "_s").join(small(ids), "dataset_id", "left").join(small(by_question), "dataset_id", "left").fillna(0, ["question_count"])
    record = record.withColumn("source_snapshot_id", T.snapshot_id(F.col("dataset_id"), F.col("split"), F.lit(source_version), F.col("processed_corpus_hash")))
    staged |= versions.stage({"record": record})
    done = spark.read.parquet(staged["record"])
    if check:
        check(done)
    totals = done.agg(F.sum("corpus_doc_count"), F.count("*")).first()
    return versions.publish(expected, staged, {"corpus_doc_count": totals[0] or 0, "groups": totals[1], "source_version": source_version})


# Registries


class Registry:
    """Records by key, as versions of changes; a version that holds all of them shortens what is read."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "dataset_id"):
        self.versions, self.key = Versions(spark, folder), key

    def _since_full(self, version: int) -> list[tuple[int, dict]]:
        """The entries that make up a version, newest first, down to the last one that is whole."""
        out = []
        for n in range(version, 0, -1):
            out.append((n, self.versions.entry(n)))
            if out[-1][1]["facts"]["whole"]:
                break
        return out

    def read(self, version: int | None = None) -> DataFrame | None:
        """The newest record of each key, with the version that it is of; None before the first version."""
        version = self.versions.newest() if version is None else version
        entries = self._since_full(version)
        if not entries:
            return None
        rows = None
        for n, e in entries:
            part = self.versions.spark.read.parquet(e["tables"]["records"])
            part = part if "version" in part.columns else part.withColumn("version", F.lit(n))
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        if len(entries) == 1:
            return rows
        others = [c for c in rows.columns if c != self.key]
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*others), "version").alias("_r")).select(self.key, "_r.*")

    def update(self, changes: DataFrame, expected: int) -> int:
        """Records that replace those of their keys, if ``expected`` is still the newest version.

        A key that is given twice is an error, and so is a conflict; neither changes anything.
        """
        staged = self.versions.stage({"records": changes})
        rows = self.versions.spark.read.parquet(staged["records"])
        twice = rows.groupBy(self.key).count().where("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"more than one record for {twice[0][0]}")
        return self.versions.publish(expected, staged, {"whole": expected == 0, "changed": rows.count()})

    def compact(self) -> int:
        """A version with the same records in one table; changes that come meanwhile make it a conflict."""
        newest = self.versions.newest()
        staged = self.versions.stage({"records": self.read(newest)})
        return self.versions.publish(newest, staged, {"whole": True, "changed": 0})

    def history(self, key_value: str) -> list[tuple[int, str]]:
        """(version, record as canonical JSON) of each change of a key, oldest first."""
        out = []
        for n in range(1, self.versions.newest() + 1):
            e = self.versions.entry(n)
            if e["facts"]["changed"]:
                rows = self.versions.spark.read.parquet(e["tables"]["records"]).where(F.col(self.key) == key_value)
                out += [(n, r[0]) for r in rows.select(canonical_json(rows)).collect()]
        return out


def with_snapshot(registry: DataFrame, record: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Registry records of the keys in a snapshot's record, with its facts: ready as a source, index unset.

    ``record`` has one row a key with source_snapshot_id, processed_corpus_hash and split_hash.
    """
    fresh = record.select(key, *[F.col(c).alias(f"_{c}") for c in ("source_snapshot_id", "processed_corpus_hash", "split_hash")])
    rows = registry.join(fresh, key)
    out = rows.withColumns({c: F.col(f"_{c}") for c in ("source_snapshot_id", "processed_corpus_hash", "split_hash")})
    return out.withColumns({"retrieval_index_path": F.lit("unset"), "status": F.lit("source_ready")}).select(*registry.columns)
