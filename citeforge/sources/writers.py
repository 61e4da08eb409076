"""Sinks: canonical JSON lines, CSV with a fixed header, small reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as t

from citeforge.sources.folders import put_once


def _sorted(c: Column, kind: t.DataType) -> Column:
    """A value with the fields of its structs in alphabetical order, at every level."""
    if isinstance(kind, t.StructType):
        inner = F.struct(*[_sorted(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
        return F.when(c.isNotNull(), inner)
    if isinstance(kind, t.ArrayType):
        return F.transform(c, lambda x: _sorted(x, kind.elementType))
    return c


def canonical_json(df: DataFrame) -> Column:
    """Rows as JSON with sorted keys, nulls kept."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    return F.to_json(F.struct(*[_sorted(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields]), {"ignoreNullFields": "false"})


def write_json_lines(df: DataFrame, path: str) -> None:
    """Canonical JSON lines; Spark's commit makes the folder appear whole or not at all."""
    df.select(canonical_json(df).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV of the given columns in order; missing ones and nulls are empty."""
    chosen = [F.col(c) if c in df.columns else F.lit("").alias(c) for c in columns]
    df.select(*chosen).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def write_json_rows(df: DataFrame, path: str) -> None:
    """JSON lines with the fields in the table's order; nulls are left out."""
    df.write.mode("overwrite").json(path)


def discovered_columns(rows: DataFrame, order: str, cells: str = "cells") -> list[str]:
    """The keys of rows of (key, value) cells in the order in which they are first seen; at most 10,000.

    ``order`` numbers the rows; keys of one row come in its own order.
    """
    seen = rows.select(F.col(order).alias("row"), F.posexplode(cells).alias("pos", "c")).select(F.struct("row", "pos").alias("at"), "c.key")
    keys = seen.groupBy("key").agg(F.min("at").alias("at")).orderBy("at").limit(10_001).collect()
    if len(keys) > 10_000:
        raise ValueError("more than 10,000 columns")
    return [r["key"] for r in keys]


def write_discovered_csv(rows: DataFrame, order: str, path: str, last: list[str], cells: str = "cells") -> list[str]:
    """CSV of rows of cells under the columns that are found in them, then ``last``; the header is
    returned. A key that a row has twice keeps its last value."""
    columns = [c for c in discovered_columns(rows, order, cells) if c not in last] + last
    value = lambda c: F.element_at(F.concat(F.array(F.lit("")), F.transform(F.filter(cells, lambda x: x["key"] == c), lambda x: F.coalesce(x["value"], F.lit("")))), -1)
    table = rows.select(*[value(c).alias(c) for c in columns])
    table.write.mode("overwrite").option("header", True).csv(path)
    return columns


def write_artifacts(records: DataFrame, summary_: DataFrame, failed: DataFrame, folder: str) -> dict[str, str]:
    """What a run leaves: its records, summary and failures as canonical JSON lines, by name."""
    parts = {"run_records": records, "summary": summary_, "failures": failed}
    for name, df in parts.items():
        write_json_lines(df, f"{folder}/{name}")
    return {name: f"{folder}/{name}" for name in parts}


def write_run(records: DataFrame, folder: str, failed: Column, totals: dict[str, Column]) -> dict:
    """All that a run leaves, from one evaluation of its records: canonical JSON lines below
    ``artifact=run_records`` and, for rows where ``failed`` holds, ``artifact=failures``, and ``summary.json``.

    ``totals`` are aggregates by name, taken while the rows are written; they are returned too.
    """
    spark, watch = records.sparkSession, Observation()
    seen = records.observe(watch, *[c.alias(n) for n, c in totals.items()])
    names = F.when(failed, F.array(F.lit("run_records"), F.lit("failures"))).otherwise(F.array(F.lit("run_records")))
    tagged = seen.select(names.alias("_names"), canonical_json(records).alias("value")).select(F.explode("_names").alias("artifact"), "value")
    tagged.write.mode("overwrite").partitionBy("artifact").text(folder)
    found = watch.get
    put_once(spark, f"{folder}/summary.json", json.dumps(found, indent=2, sort_keys=True, ensure_ascii=False, default=str) + "\n")
    return found


def report(df: DataFrame, columns: list[str], most: int = 1000) -> str:
    """A Markdown table of a small result; larger ones are refused, not cut."""
    rows = df.select(*columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for a report")
    show = lambda v: "" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(show(v) for v in r) + " |" for r in rows)]) + "\n"


def summary(df: DataFrame) -> str:
    """One row as indented JSON with sorted keys."""
    return json.dumps(df.first().asDict(recursive=True), indent=2, sort_keys=True, ensure_ascii=False, default=str) + "\n"
