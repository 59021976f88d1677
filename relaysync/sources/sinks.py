"""Sinks (A5, A6, A7): requests, outcomes and triples tables.

Batch writes are plain parquet appends / overwrites.  Stream writes go
through ``foreachBatch`` with one directory per batch id (overwritten on
replay), so a batch re-run after a failure never duplicates rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from relaysync.streaming.pipeline import idempotent_writer

REQUEST_COLUMNS = ["request_id", "seq", "ts", "stream", "route", "method", "uri", "content_location",
                   "base_url", "headers"]


def write_requests(requests: DataFrame, path: str, mode: str = "append") -> None:
    """Request table, partitioned by route (each downstream sender reads its own)."""
    requests.select(*REQUEST_COLUMNS).write.mode(mode).partitionBy("route").parquet(path)


def write_outcomes(outcomes: DataFrame, path: str, mode: str = "append") -> None:
    outcomes.write.mode(mode).partitionBy("outcome").parquet(path)


def write_triples(triples: DataFrame, path: str) -> None:
    """Replace the triples table with the state after the batch (E2/E3 result)."""
    triples.write.mode("overwrite").parquet(path)


def write_triples_table(triples: DataFrame, table: str, buckets: int) -> None:
    """Store the triples as a catalog table bucketed (and sorted) by subject.

    The per-batch replace/delete joins the whole triples table on ``s``; with
    the table bucketed on ``s`` that join reads it without an exchange and
    only the (much smaller) changed-subject side is shuffled to the buckets.
    Overwrite the table under a new name per version and swap readers over
    (a table cannot be overwritten while it is being read).
    """
    (triples.write.mode("overwrite").bucketBy(buckets, "s").sortBy("s").format("parquet")
     .saveAsTable(table))


def stream_to(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", trigger: dict | None = None):
    """Start a streaming sink with the idempotent per-batch writer; returns the query."""
    w = (stream.writeStream.outputMode(mode).foreachBatch(idempotent_writer(path))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()
