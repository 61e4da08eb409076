"""Incremental runs: skipping what is finished, and a streaming audit of new run records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from citeforge.operators.attribution import validate


def pending(planned: DataFrame, finished: DataFrame, key: str = "run_id") -> DataFrame:
    """Planned runs that have no finished record."""
    return planned.join(finished.select(key), key, "left_anti")


def stream_audit(citations: DataFrame, ledger: DataFrame, retrieved: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Validate a stream of citations against the ledger and append the verdicts to a table.

    Validation looks at one citation at a time, so each micro-batch is validated on its own; the
    batch's number is a column, and a batch that runs again after a failure replaces its folder.
    """

    def append(batch: DataFrame, number: int) -> None:
        validate(batch, ledger, retrieved).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return citations.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_errors(validated: DataFrame, ts: str, size: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Validation errors by time window, with a watermark that drops state of old windows."""
    return validated.withWatermark(ts, late).groupBy(F.window(ts, size), "validation_error").agg(F.count("*").alias("n"))


def on_progress(report: Callable[[dict], None]):
    """A listener that reports each micro-batch's progress."""
    from pyspark.sql.streaming import StreamingQueryListener

    class Progress(StreamingQueryListener):
        def onQueryStarted(self, event):
            report({"event": "started", "id": str(event.id)})

        def onQueryProgress(self, event):
            report({"event": "progress", "batch": event.progress.batchId, "rows": event.progress.numInputRows})

        def onQueryTerminated(self, event):
            report({"event": "terminated", "id": str(event.id)})

    return Progress()
