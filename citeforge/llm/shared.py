"""Shared folders and materialised intermediate tables.

Every intermediate file goes below ``spark.checkpoint.dir``, which the driver and all executors
see. A table that was written there cuts the lineage: a lost executor costs only its own tasks.
"""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeforge.operators import sizing


#: Folders of local sessions that name none, by application.
_own: dict[str, str] = {}


def base_dir(spark: SparkSession) -> str:
    """The session's shared folder; a temporary one only where none is set and Spark runs locally."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, "")
        if not base:
            base = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return base.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """The URI of a folder of its own, not made yet."""
    return f"{base_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of a few numbers that one task writes where the number of rows is known.
TASK_ROWS = 1 << 16


def materialize(df: DataFrame, name: str, rows: int | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and return the table read back.

    Where a bound on its ``rows`` is known, tasks write about ``task_rows`` of them each, and as many
    tasks as there are cores share fewer: a small table is not spread over all of a shuffle's
    partitions. All rows are written in any case.
    """
    spark = df.sparkSession
    path = new_dir(spark, name)
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // task_rows)))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Written tables are broadcast up to this many bytes, as measured, else joined over a shuffle.
BROADCAST_BYTES = sizing.BROADCAST_BYTES


def is_small(df: DataFrame) -> bool:
    """Whether a written table's measured size is within the bound for a broadcast.

    The table is read once to measure it, so it should be one that ``materialize`` gave, or a few
    columns of one.
    """
    return sizing.is_small(df, BROADCAST_BYTES)


def small(df: DataFrame) -> DataFrame:
    """A broadcast hint where ``is_small`` holds."""
    return F.broadcast(df) if is_small(df) else df


def sample_ids(rows: DataFrame, most: int) -> list[int]:
    """Up to ``most`` distinct doc_ids, those of the smallest hashes.

    A bound on the hash, from the number of rows, keeps what each task sends to the driver small on
    any number of partitions; it lets about four times as many ids pass as are asked for.
    """
    n = rows.count()
    h = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    if n > 4 * most:
        rows = rows.where(h < int((1 << 63) * (4 * most / n)))
    return [r[0] for r in rows.select("doc_id", h.alias("h")).distinct().orderBy("h", "doc_id").limit(most).collect()]


def _filesystem(uri: str):
    """(pyarrow file system, path) of a URI; local paths need no scheme."""
    from pyarrow import fs

    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, chunks) -> int:
    """Write byte chunks under an attempt's own name, then move the file into place; its size.

    Tasks write the same bytes when they run again, so whichever attempt moves last is right.
    """
    import posixpath

    store, path = _filesystem(uri)
    store.create_dir(posixpath.dirname(path), recursive=True)
    attempt, size = f"{path}.{uuid.uuid4().hex}.tmp", 0
    with store.open_output_stream(attempt, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    store.move(attempt, path)
    return size


def open_file(uri: str):
    """A seekable binary reader."""
    store, path = _filesystem(uri)
    return store.open_input_file(path)
