"""Sizes of tables, for joins whose small side is broadcast only within a bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

#: Tables are broadcast up to this many bytes, as measured, else joined over a shuffle.
BROADCAST_BYTES = 32 << 20


def width(c: Column, kind: t.DataType) -> Column:
    """Bytes of a value: 16 for a number, a string's own, the sum of an array's elements."""
    if isinstance(kind, t.StringType):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long") + 16
    if isinstance(kind, t.StructType):
        return sum((width(c[f.name], f.dataType) for f in kind.fields), F.lit(16).cast("long"))
    if isinstance(kind, t.ArrayType):
        each = F.coalesce(F.transform(c, lambda x: width(x, kind.elementType)), F.array().cast("array<bigint>"))
        return F.aggregate(each, F.lit(16).cast("long"), lambda a, x: a + x)
    return F.lit(16).cast("long")


def is_small(df: DataFrame, most: int | None = None) -> bool:
    """Whether the table's measured size is within the bound; the table is read once for it."""
    row = sum((width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0).cast("long"))
    return df.select(row.alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] <= (BROADCAST_BYTES if most is None else most)


def small(df: DataFrame) -> DataFrame:
    """A broadcast hint where ``is_small`` holds."""
    return F.broadcast(df) if is_small(df) else df
