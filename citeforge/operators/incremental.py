"""Incremental validation: only citations that are new or changed are validated, the rest is taken over.

What a validation depends on is hashed: the citation's own columns, and a digest of the ledger and
the retrieved ids it is held against. A stored result counts while both are the same. Each update
is a version of the whole result (see ``snapshots``), so a reader sees one update or the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeforge.functions import text as T
from citeforge.operators.attribution import PARTS, validate
from citeforge.operators.judging import settled
from citeforge.operators.snapshots import Versions
from citeforge.sources.writers import canonical_json


def ground_digest(ledger: DataFrame, retrieved: DataFrame) -> str:
    """One digest of all that citations are validated against; it does not depend on the rows' order.

    Rows are hashed and the hashes summed, with their number, so it is one aggregate of each table.
    """

    def summed(rows: DataFrame) -> str:
        key = F.concat(*[x for c in rows.columns for x in (F.length(F.coalesce(c, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(c, F.lit("")))])
        digest = T.sha256(key)
        parts = [F.sum(F.conv(F.substring(digest, k, 8), 16, 10).cast("decimal(38,0)")) for k in range(1, 65, 8)]
        return str(tuple(rows.distinct().agg(F.count("*"), *parts).first()))

    whole = summed(ledger.select(*PARTS)) + summed(retrieved.select("citation_id"))
    return ledger.sparkSession.range(1).select(T.sha256(F.lit(whole))).first()[0]


class ValidationStore:
    """Validations of citations by ``keys``, which name a citation uniquely."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str]):
        self.versions, self.keys = Versions(spark, folder), keys

    def update(self, citations: DataFrame, ledger: DataFrame, retrieved: DataFrame) -> DataFrame:
        """``validate`` of all citations, with ``reused``; citations that are gone leave the store.

        A key that is there twice is validated each time. Of two updates at once the second one fails.
        """
        newest = self.versions.newest()
        ground = ground_digest(ledger, retrieved)
        rows = settled(citations.withColumn("_print", T.sha256(canonical_json(citations))))
        held = None
        if newest and self.versions.entry(newest)["facts"]["ground"] == ground:
            held = self.versions.read("validations", newest).drop("reused")
        if held is None:
            kept, fresh = None, rows
        else:
            once = held.dropDuplicates([*self.keys, "_print"])
            extra = [c for c in once.columns if c not in rows.columns]
            kept = rows.join(once.select(*self.keys, "_print", *extra), [*self.keys, "_print"]).withColumn("reused", F.lit(True))
            fresh = rows.join(once.select(*self.keys, "_print"), [*self.keys, "_print"], "left_anti")
        checked = validate(fresh, ledger, retrieved).withColumn("reused", F.lit(False))
        every = checked if kept is None else checked.unionByName(kept)
        staged = self.versions.stage({"validations": every})
        self.versions.publish(newest, staged, {"ground": ground})
        return self.versions.spark.read.parquet(staged["validations"]).drop("_print")
